"""Every registered query of the library against its SQL twin, on the smallest tables."""

import datetime
import os

import pytest

import __spark_entry__
from weftline import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    run = sql.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in run.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
