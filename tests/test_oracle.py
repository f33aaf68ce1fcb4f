"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(plain(v) for v in row)) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    want = duck.sql(entry.oracle_sql()[name])
    kinds = dict(got.dtypes)
    assert {c: TYPES[kinds[c]] for c in kinds} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert normal(got.toPandas()) == normal(want.df())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
