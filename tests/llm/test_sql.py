"""Every training-data query that has SQL, against it, on the smallest tables."""

import os

import pytest

from weftline.llm import catalog

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    run = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in run.description]
    df = catalog.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(map(str, r)) for r in run.fetchall())
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == want and want
