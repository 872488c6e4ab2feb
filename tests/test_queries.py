"""Every registered query of the library runs, and those with SQL give its rows."""

import math
import os

import duckdb
import pytest

from loomsift.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def key(row):
    return tuple((x is None, "" if x is None else round(x, 6) if isinstance(x, float) and not math.isnan(x) else x) for x in row)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((key(r) for r in got.select(*columns).collect()), key=repr)
    if name in catalog.ORACLE_SQL:
        want = sql.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        order = ", ".join(f'"{c}"' for c in columns)
        assert rows == sorted((key(r) for r in sql.sql(f"SELECT {order} FROM want").fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
