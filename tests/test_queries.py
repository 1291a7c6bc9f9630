"""Registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
#: Those that parse all coordinate patterns, or chain many rules, take half a minute each to plan.
SLOW = {"pat_coord_dd", "pat_coord_dms", "coord_association", "annotations_roundtrip", "related_merge", "profile_located"}
CHECKED = sorted(set(__spark_entry__.oracle_sql()) - SLOW)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())
    spark.catalog.clearCache()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
