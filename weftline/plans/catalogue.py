"""All queries over the relational tables, and their SQL twins.

Each query applies the library's operators to the given tables; the tables stand
in for listings (orders for courses, customers for providers, nations and regions
for cities and areas).  Whole tables are read; limits are part of a report only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import facets, hubs, integration, matching, pages, reports, sources, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (facets, hubs, integration, matching, pages, reports, sources, texts):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
