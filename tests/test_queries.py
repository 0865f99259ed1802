"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([[plain(r[c]) for c in cols] for r in df.collect()], key=repr)
    rel = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted([[plain(r[names.index(c)]) for c in cols] for r in rel.fetchall()], key=repr)
    assert got == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
