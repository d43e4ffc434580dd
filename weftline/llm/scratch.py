"""Reading the given tables, and cutting long lineages in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import cut, drop

__all__ = ["cut", "drop", "short_batches", "table"]

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 1,000 rows where the session has Spark's default of 10,000.

    Rows are whole documents here, and a batch lies in a task's memory several times.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
