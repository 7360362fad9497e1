"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from colloquy import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None and not (isinstance(v, float) and math.isnan(v)) else 0) for v in r)
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in data), key=key)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    b = rows(columns, want.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1], strict=True):
        assert x == pytest.approx(y) if any(isinstance(v, float) for v in x) and not any(isinstance(v, str) for v in x) else x == y


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, DIR)
    assert df.columns
    df.count()


def test_linked_components_covers_all_orders(spark, tmp_path):
    orders = {1: [7, 8], 2: [8, 9], 40: [1, 2], 41: [2, 3], 79: [20], 80: [5]}
    spark.createDataFrame([(o, s) for o, held in orders.items() for s in held], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in catalog.QUERIES["linked_components"](spark, str(tmp_path)).select("node", "root").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 7), (8, 7), (9, 7), (20, 20)}
