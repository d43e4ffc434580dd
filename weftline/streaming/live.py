"""Streaming forms: snapshot merges by micro-batch, windowed counts, keyed schedules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.observe import DAY, HOUR, snapshot_merge


def merge_stream(stream: DataFrame, load: Callable[[int], DataFrame], save: Callable[[DataFrame, int], None], today: Callable[[DataFrame, int], Column], key: str = "id"):
    """A writer that merges every micro-batch of listings into the stored history.

    A micro-batch is one whole snapshot of its sources (one landed file a trigger): what
    it does not list has disappeared.  ``load`` reads the history as it was before a
    batch and ``save`` stores the merged one under the batch's number, so a batch that
    runs again, or a stream that starts again, reads and writes the same versions.
    ``today`` gives a batch's date from what the batch itself says, never from the clock,
    so that a batch that runs again writes the same dates.
    """

    def merge(batch: DataFrame, number: int) -> None:
        save(snapshot_merge(batch, load(number), key, today(batch, number)).drop("change"), number)

    return stream.writeStream.foreachBatch(merge)


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by time window; rows later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", *keys, "n")


STATE = "content_hash string, interval_ms long, unchanged long, failures long"
OUT = "source string, interval_ms long, unchanged long, failures long, next_due_ms long"


def step(state: tuple, at: int, new_hash: str | None, failed: bool, least: int = 6 * HOUR, most: int = 7 * DAY) -> tuple:
    """The state (hash, interval, unchanged, failures) after one run."""
    old, interval, unchanged, failures = state
    if failed:
        return old, interval, unchanged, failures + 1
    if old != new_hash:
        return new_hash, int(max(least, min(interval / 2, most))), 0, 0
    unchanged += 1
    ceiling = max(most, 30 * DAY) if unchanged >= 10 else most
    return new_hash, int(min(ceiling, interval * 1.5)), unchanged, 0


def schedule_stream(runs: DataFrame) -> DataFrame:
    """The schedule of every source, kept as keyed state over a stream of runs
    (source, at_ms, new_hash, failed)."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, DAY, 0, 0)
        at = 0
        for pdf in batches:
            for row in pdf.sort_values("at_ms").itertuples():
                now = step(now, row.at_ms, row.new_hash, bool(row.failed))
                at = row.at_ms
        state.update(now)
        yield pd.DataFrame({"source": [key[0]], "interval_ms": [now[1]], "unchanged": [now[2]], "failures": [now[3]], "next_due_ms": [at + now[1]]})

    return runs.groupBy("source").applyInPandasWithState(advance, OUT, STATE, "update", "NoTimeout")


def versions(spark: SparkSession, path: str, schema: str) -> tuple[Callable[[int | None], DataFrame], Callable[[DataFrame, int], None]]:
    """``load`` and ``save`` over numbered Parquet folders.

    ``load(number)`` reads the highest finished version below ``number``, ``load()`` the
    highest of all; which versions there are is read from the folder, never remembered.
    """

    def finished() -> list[int]:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
        return [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and done(n)]

    def load(number: int | None = None) -> DataFrame:
        below = [n for n in finished() if number is None or n < number]
        return spark.read.schema(schema).parquet(f"{path}/v={max(below)}") if below else spark.createDataFrame([], schema)

    def save(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/v={number}")

    return load, save
