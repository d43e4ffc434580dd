"""Row and batch validation, and link checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that a row fails, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in checks]))


def timetable_checks(today: Column) -> list[tuple[str, Column]]:
    """The rules for rows that were read from timetable images."""
    minutes = lambda c: F.substring(c, 1, 2).try_cast("int") * 60 + F.substring(c, 4, 2).try_cast("int")
    c = F.col
    length = minutes(c("end_time")) - minutes(c("start_time"))
    clock = "^([01][0-9]|2[0-3]):[0-5][0-9]$"
    return [
        ("title", F.coalesce(F.trim(c("title")), F.lit("")) == ""),
        ("weekdays", (F.size("weekdays") == 0) | F.exists("weekdays", lambda d: ~d.between(1, 7))),
        ("time", ~c("start_time").rlike(clock) | ~c("end_time").rlike(clock)),
        ("length", ~length.between(20, 240)),
        ("early", c("start_time") < "05:00"),
        ("date", F.abs(F.datediff(F.to_date("start_date"), F.to_date(today))) > 400),
        ("span", ~F.datediff(F.to_date("end_date"), F.to_date("start_date")).between(0, 200)),
        ("sessions", ~c("sessions").between(1, 60)),
        ("price", ~c("price").between(0, 100000)),
    ]


def batch_verdict(rows: DataFrame, keys: list[str], bad: Column, most_rows: int | None = 400) -> DataFrame:
    """Reject a batch with more than max(2, a tenth) bad rows, too many, or none good."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"))
    reject = (F.col("n_bad") > F.greatest(F.lit(2), F.col("n") * 0.1)) | (F.col("n_bad") == F.col("n"))
    if most_rows:
        reject = reject | (F.col("n") > most_rows)
    return out.withColumn("rejected", reject)


def links(pages: DataFrame, html: str, id_col: str) -> DataFrame:
    """(id, href): every link of every page."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""href=["']([^"'#]+)"""), F.lit(1))
    return pages.select(id_col, F.explode(found).alias("href"))


def broken_links(pages: DataFrame, html: str, id_col: str, url: str) -> DataFrame:
    """Links that lead to no page."""
    return links(pages, html, id_col).distinct().join(pages.select(F.col(url).alias("href")).distinct(), "href", "left_anti")


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df``; the query fails on the first row for which ``ok`` does not hold."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
