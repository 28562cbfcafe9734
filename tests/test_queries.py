"""Every query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tracewell.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.execute(registry.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
