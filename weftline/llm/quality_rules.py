"""Quality rules: an ordered decision list, learned from labelled statistics.

*Statistics* are counts over a whole text (words are runs without ASCII white space);
``FEATURES`` are ratios of them.

*Learning* is sequential covering.  Labelled rows fall into a growing part (two thirds)
and a pruning part, by a hash of their id.  A rule for bad documents grows on the first:
the condition ``feature > threshold`` or ``feature <= threshold`` with the largest
information gain is added until no good document is covered any more.  It is pruned on
the second: of all its beginnings the one stays that parts bad from good best, the
shortest of equals.  A good document that a rule covers counts ``GOOD_COST`` times.  A
rule that covers a smaller share of bad documents than ``min_precision`` ends the list;
rows that a rule covers (the fixed ones come first) are out for the later ones.
Thresholds are the shortest decimal numbers well between two neighbouring values.

*Emission*: the list becomes one ``CASE WHEN`` of Spark's own functions, the first rule
that fits names itself; a document that none fits is kept.  Two fixed rules come before:
fewer than 50 words, and more than half of the words in repeated three-word windows.

At most ``max_labelled`` labelled rows (by hash of id) reach the driver, as numbers; the
statistics and the rules cover every document, and nothing is shuffled for them.

Edge cases: a null or empty text has zero counts and fails the first fixed rule.  Without
labels of both kinds there are no learned rules.  Rows with equal ids are judged each by
its own text; for learning, the one with the smallest statistics stands for a repeated
id, and the best label for a repeated label; null ids and labels teach nothing.  Texts
are read whole, in runs whose memory follows the largest text.  Other columns stay; those
with the names of the output are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .quality import labelled_sample
from .scratch import table

MAX_LABELLED = 20_000
MIN_PRECISION = 0.95
GOOD_COST = 5  # how many bad documents may be kept for one good document that is dropped
MAX_RULES = 24
MAX_CONDITIONS = 5

#: Fixed values of the base statistics and rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_echoes", "n_upper_words")
#: name: (count, of which count)
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "upper_words_share": ("n_upper_words", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "echo_share": ("n_echoes", "n_words"),
    "duplicate_lines_share": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def _byte_table(chars: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _byte_table(map(ord, SYMBOLS))
_UPPER, _LOWER, _DIGIT = _byte_table(range(65, 91)), _byte_table(range(97, 123)), _byte_table(range(48, 58))
_MARK = _byte_table(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in SYMBOLS)
_INNER = _byte_table(range(128, 192))  # bytes of a code point behind its first


def counts_of(raw: bytes, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of each text of a run."""
    n, data = len(offsets) - 1, np.frombuffer(raw, np.uint8)
    if not len(data):
        return {c: np.zeros(n, np.int64) for c in COUNTS}

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=n).astype(np.int64)

    starts, ends = hashing.word_spans(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    own = hashing.mix(owner.astype(np.uint64) + np.uint64(1))
    h = hashing.spans_hash(data, starts, ends)

    window = np.zeros(max(0, len(h) - 2), np.uint64)
    for k in range(3):
        window += h[k : k + len(window)] * hashing._GRAM[k]
    at = np.flatnonzero(owner[: len(window)] == owner[2:]) if len(window) else np.zeros(0, np.int64)
    _, place, times = np.unique(hashing.mix(window[at]) ^ own[at], return_inverse=True, return_counts=True)
    again = at[times[place] > 1]
    repeated = np.zeros(len(h), bool)
    for k in range(3):
        repeated[again + k] = True
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])

    new = np.zeros(len(data) + 1, bool)
    new[offsets] = True
    new[1:][data == 10] = True
    line_at = np.flatnonzero(new)
    line_at, line_end = line_at[:-1], line_at[1:]
    line_end = line_end - (data[line_end - 1] == 10)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_at)
    line_at, line_end = line_at[worded], line_end[worded]
    line_owner = np.searchsorted(offsets, line_at, "right") - 1
    lines = hashing.spans_hash(data, line_at, line_end) ^ hashing.mix(line_owner.astype(np.uint64) + np.uint64(1))
    n_lines = np.bincount(line_owner, minlength=n)
    n_kinds = np.bincount(line_owner[np.unique(lines, return_index=True)[1]], minlength=n)

    letters = np.zeros((2, len(data) + 1), np.int64)
    np.cumsum(_UPPER[data], out=letters[0, 1:])
    np.cumsum(_LOWER[data], out=letters[1, 1:])
    upper, lower = letters[:, ends] - letters[:, starts]
    return {
        "n_words": np.bincount(owner, minlength=n).astype(np.int64),
        "word_chars": per_text(~hashing._SPACE[data] & ~_INNER[data]),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": (n_lines - n_kinds).astype(np.int64),
        "n_repeat_words": of_words(repeated),
        "n_lines": n_lines.astype(np.int64),
        "n_upper": per_text(_UPPER[data]),
        "n_digits": per_text(_DIGIT[data]),
        "n_marks": per_text(_MARK[data]),
        "n_echoes": of_words(echo),
        "n_upper_words": of_words((upper > 1) & (lower == 0)),
    }


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(texts: pa.Array) -> pa.Array:
    parts = [counts_of(raw, offsets) for _, _, raw, offsets in hashing.runs(texts)]
    columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(COUNTS))


def features(counts: Column) -> list[Column]:
    """The ratios of ``FEATURES``; zero where there is nothing to divide by."""
    return [F.coalesce(F.try_divide(counts[a].cast("double"), counts[b].cast("double")), F.lit(0.0)).alias(name) for name, (a, b) in FEATURES.items()]


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{list(FEATURES)[self.feature]} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def between(low: float, high: float) -> float:
    """The shortest decimal number in the middle half of two neighbouring values."""
    quarter = (high - low) / 4
    for digits in range(12):
        t = round((low + high) / 2, digits)
        if low + quarter <= t <= high - quarter:
            return t
    return low


def best_condition(x: np.ndarray, bad: np.ndarray) -> Condition | None:
    """The condition with the largest gain; the first feature and threshold of equals."""
    all_bad = int(bad.sum())
    all_good = len(bad) - all_bad
    share = lambda p, g: np.log2(p / (p + GOOD_COST * g))
    base = share(all_bad, all_good)
    best, found = 1e-9, None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p = np.cumsum(bad[order])[cut]
        good = cut + 1 - p
        for above, pos, neg in ((True, all_bad - p, all_good - good), (False, p, good)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (share(pos, neg) - base), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Condition(f, above, between(float(v[cut[k]]), float(v[cut[k] + 1])))
    return found


def grow(x: np.ndarray, bad: np.ndarray, most: int = MAX_CONDITIONS) -> Rule:
    rule: Rule = ()
    while len(rule) < most and bad.any() and not bad.all():
        c = best_condition(x, bad)
        if c is None:
            break
        rule += (c,)
        inside = c.holds(x)
        x, bad = x[inside], bad[inside]
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule that parts bad from good best on rows it was not grown on."""

    def worth(r: Rule) -> float:
        inside = covers(r, x)
        p, n = int((inside & bad).sum()), GOOD_COST * int((inside & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)  # the first, so shortest, of equals


def learn(x: np.ndarray, bad: np.ndarray, growing: np.ndarray, min_precision: float = MIN_PRECISION, max_rules: int = MAX_RULES) -> list[Rule]:
    """An ordered list of rules for bad rows."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules and (g := growing & left)[bad].any() and not bad[g].all():
        rule = grow(x[g], bad[g])
        held = ~growing & left
        if not rule:
            break
        rule = prune(rule, x[held], bad[held])
        inside = covers(rule, x) & left
        shown = inside & held
        if not (shown & bad).any() or (shown & bad).sum() < min_precision * shown.sum() or (inside & bad).sum() < min_precision * inside.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def named(rule: Rule) -> str:
    return " and ".join(map(str, rule))


def first_rule(rules: list[Rule], feature: dict[str, Column]) -> Column:
    """The name of the first rule that fits, or null: one conditional expression."""
    names, out = list(FEATURES), None
    for rule in rules:
        fits = F.lit(True)
        for c in rule:
            v = feature[names[c.feature]]
            fits = fits & (v > c.threshold if c.above else v <= c.threshold)
        out = F.when(fits, named(rule)) if out is None else out.when(fits, named(rule))
    return F.lit(None).cast("string") if out is None else out


def learned_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Rules from at most ``max_labelled`` labelled documents."""
    spark = docs.sparkSession
    sample = labelled_sample(labels, max_labelled, id_col, label_col)
    if not sample:
        return []
    ids = spark.createDataFrame([(i,) for i in sample], "doc_id long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    counted = rows.select("doc_id", text_counts("text").alias("c")).where(~base_failed(F.col("c.n_words"), F.col("c.n_repeat_words")))
    made = counted.groupBy("doc_id").agg(F.min("c").alias("c")).select("doc_id", F.array(*features(F.col("c"))).alias("x"))
    got = made.withColumn("growing", F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(3)) < 2).orderBy("doc_id").collect()
    if not got:
        return []
    bad = np.array([not sample[r["doc_id"]][0] for r in got])
    return learn(np.array([r["x"] for r in got]), bad, np.array([r["growing"] for r in got]), min_precision)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """The two fixed rules."""
    return (n_words < LEAST_WORDS) | (n_repeat_words * 100 > n_words * MOST_REPEATED)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with its counts, ``base_failed``, the ``rule`` that drops a document, and ``kept``."""
    out = docs.withColumn("__counts", text_counts(F.col(text_col).cast("string")))
    out = out.withColumns({c: F.col(f"__counts.{c}") for c in COUNTS})
    rule = first_rule(rules, dict(zip(FEATURES, features(F.col("__counts")), strict=True)))
    out = out.withColumns({"base_failed": base_failed(F.col("n_words"), F.col("n_repeat_words")), "rule": rule}).drop("__counts")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's statistics, the fixed rules' verdict, and whether the list keeps it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
