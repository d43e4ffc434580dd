"""Every relational query against its SQL twin, row for row."""

import math
import os

import duckdb
import pandas as pd
import pytest

from weftline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(SF))] if os.path.isdir(SF) else []


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(str(cell(v)) for v in r) for r in df.astype(object).values.tolist()))


@pytest.mark.skipif(not TABLES, reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    fix = lambda df: df.apply(lambda s: s.astype("Int64") if s.dtype == "float64" and (s.dropna() % 1 == 0).all() else s)  # noqa: E731  nulls turn whole numbers into floats
    assert rows(fix(got)) == rows(fix(want))


def test_every_query_but_clusters_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"cluster_greedy"}


def test_filters_and_columns_reach_the_scan(spark):
    if not TABLES:
        pytest.skip("no tables")
    plan = catalogue.QUERIES["anti_incremental"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,20.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_slugs_that_are_taken_at_both_lengths_are_left_out_as_in_the_sql(spark, tmp_path):
    import hashlib
    from collections import defaultdict

    alike = defaultdict(list)
    for k in range(600_000):
        alike[hashlib.sha256(str(k).encode()).hexdigest()[:6]].append(k)
    keys = next(v for v in alike.values() if len(v) > 2 and sum(k % 3 > 0 for k in v) > 1)
    con = duckdb.connect()
    con.execute(f"copy (select unnest({keys})::bigint as p_partkey, 'Brand#7' as p_brand) to '{tmp_path}/part.parquet'")
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["slug_assign"]).df()
    assert rows(catalogue.QUERIES["slug_assign"](spark, str(tmp_path)).toPandas()) == rows(want) and len(want) < sum(k % 3 > 0 for k in keys)
