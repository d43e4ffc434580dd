"""The subpackage's queries, and SQL for those that SQL can express."""

from . import ann, jaccard_join, line_dedup, mixing, packing, phrases, quality, quality_rules, quotes, secrets, spelling, topk_join, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op10_quote_linking": quotes.op10_quote_linking,
    "op11_phrase_collocations": phrases.op11_phrase_collocations,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_quality_rules": quality_rules.op13_quality_rules,
    "op2_fuzzy_line_dedup": line_dedup.op2_fuzzy_line_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_ann_forest": ann.op5_ann_forest,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_exact_topk": topk_join.op7_exact_topk,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_quality_resampling": quality.op9_quality_resampling,
}

ORACLE_SQL = {
    "op11_phrase_collocations": phrases.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op1_url_filter": url_filter.ORACLE,
    "op7_exact_topk": topk_join.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
}
