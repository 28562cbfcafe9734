"""The queries that SQL can express against their SQL, on the smallest tables."""

import os

import pytest

from tracewell.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and canonical(ours) == canonical(theirs)
