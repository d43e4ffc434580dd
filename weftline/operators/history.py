"""A history of listings in buckets, merged in place.

The table lies in one folder a part: a source and a bucket of its key's hash.  A snapshot
reads, merges and rewrites only the parts that it touches, by dynamic partition overwrite;
all others keep their files.  Every date comes from the caller, rows lie sorted in their
files, and the merged rows are written beside the table before they replace anything: a
batch that runs again writes the same rows, and one that is lost half way can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut, drop
from .observe import snapshot_merge

#: What the history adds to a snapshot's key, source, payload and content_hash.
DATES = ("first_observed", "last_verified", "last_changed", "disappeared")


def part_of(source: Column, key: Column, buckets: int) -> Column:
    """The folder of a row."""
    return F.concat_ws("-", F.coalesce(source.cast("string"), F.lit("none")), F.lpad(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"), 6, "0"))


def _empty(like: DataFrame) -> DataFrame:
    return like.limit(0).withColumns({c: F.lit(None).cast("string") for c in DATES})


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored rows; none where nothing is stored yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return _empty(like).withColumn("part", F.lit(None).cast("string"))
    fields = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema], *[f"{c} string" for c in DATES], "part string"]
    return spark.read.schema(", ".join(fields)).parquet(path)


def merge_snapshot(path: str, new: DataFrame, today: Column, key: str = "id", buckets: int = 64, whole: bool = True) -> DataFrame:
    """Merge ``new`` (key, source, payload, content_hash) into the history at ``path``.

    A ``whole`` snapshot lists everything its sources have: what it leaves out has
    disappeared, so it touches all parts of those sources.  Another one only adds and
    changes, and touches the parts of its keys, whose other rows stay as they are.  Keys
    are unique over all sources; rows with a null key take no part.  Returns (key, change)
    of the rows of the parts touched.
    """
    spark = new.sparkSession
    rows = new.where(F.col(key).isNotNull()).select(key, "source", "payload", "content_hash")
    rows = cut(rows.withColumn("part", part_of(F.col("source"), F.col(key), buckets)), "batch")
    old = _read(spark, path, rows.drop("part"))
    if whole:  # at most as many names as the table has folders reach the driver
        sources = [r[0] for r in rows.select(F.coalesce(F.col("source").cast("string"), F.lit("none"))).distinct().collect()]
        touched = F.regexp_extract("part", "^(.*)-[0-9]+$", 1).isin(sources) if sources else F.lit(False)
    else:
        touched = F.col("part").isin([r[0] for r in rows.select("part").distinct().collect()])
    old = old.where(touched).drop("part")
    listed = old if whole else old.join(rows.select(key), key, "left_semi")
    sources_of = rows.select(key, "source").unionByName(listed.select(key, "source")).groupBy(key).agg(F.min("source").alias("source"))
    merged = snapshot_merge(rows.drop("part", "source"), listed.drop("source"), key, today).join(sources_of, key)
    if not whole:
        merged = merged.unionByName(old.join(rows.select(key), key, "left_anti").withColumn("change", F.lit("untouched")))
    merged = merged.withColumn("part", part_of(F.col("source"), F.col(key), buckets))
    merged = cut(merged.select(key, "source", "payload", "content_hash", *DATES, "part", "change"), "merged")
    stored = merged.drop("change").repartition("part").sortWithinPartitions("part", key)
    stored.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    drop(rows)
    return merged.select(key, "change")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The whole history."""
    return spark.read.parquet(path).drop("part")
