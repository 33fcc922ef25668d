"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from foliant import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_matches_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    want = duck.sql(plans.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert [KINDS[dict(df.dtypes)[c]] for c in cols] == [str(dict(zip(want.columns, want.types))[c]) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_flagship(spark):
    assert plans.flagship(spark, SF).count() > 0
