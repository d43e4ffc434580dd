"""A corpus pipeline of five stages; each works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.

1. ``quality``: importance resampling; documents that it does not draw go.
2. ``line_dedup``: lines that are (near) copies of earlier ones are removed; a
   document that had words and has none left goes.
3. ``near_duplicates``: components of documents whose five-word shingle sets are
   at least 0.8 similar; the one with the smallest id stays.
4. ``mix``: budgets by domain, language and source; the chosen prefix stays (one
   epoch, so no document is repeated); rows that are equal in all columns count and
   stay together, so a budget is never passed.
5. ``pack``: pieces of the documents in bins.

Edge cases: null texts pass the first three stages as they are (nothing speaks
against them) and are packed without a bin.  Rows with a null id form no group.  Rows
with equal ids and different texts are judged each by its own text; of repeated rows one
stays.  Texts of any length are taken whole.  Other columns than those of ``documents``
stay as they are; names that start with ``__`` are taken.  Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.jaccard_join import jaccard_components
from weftline.llm.line_dedup import dedup_lines
from weftline.llm.mixing import domain_of, mix_sources, n_words
from weftline.llm.packing import measured, pack_documents
from weftline.llm.quality import resample
from weftline.llm.scratch import cut, short_batches, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    drawn = resample(docs, table(spark, sf_dir, "labels"), names=("__weight", "__key", "__drawn"))
    return drawn.where("__drawn").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    left = dedup_lines(docs, lines_col="__lines", removed_col="__removed")
    emptied = (F.col("__removed") > 0) & (n_words(F.col("text")) == 0)
    return left.where(~emptied).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    rows = docs.where("doc_id is not null").withColumn("__row", F.xxhash64(*docs.columns))
    found = jaccard_components(rows, n=5, percent=80, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id").distinct()
    first = found.join(rows.select("__row", "doc_id").distinct(), "__row").groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first"))
    kept = rows.join(first.select("first.__row"), "__row", "left_semi").dropDuplicates(["__row"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.xxhash64(*docs.columns).alias("__row")
    rows = docs.select(row, "lang", "source", n_words(F.col("text")).alias("n"))
    units = rows.groupBy("__row", "lang", "source").agg(F.sum("n").alias("n_tokens"))
    taken = mix_sources(units.withColumn("domain", domain_of(F.col("source"))), id_col="__row", fraction=(9, 10), power=0.8, max_epochs=1)
    kept = taken.select("__row").distinct()
    return docs.withColumn("__row", row).join(kept, "__row", "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(measured(docs.select("doc_id", "source", "text")))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the given documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
