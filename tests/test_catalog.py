"""Every query with an SQL twin gives the twin's rows."""

import glob
import os

import duckdb
import pytest

from skein import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    found = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert found
        return
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, found) == rows(columns, cursor.fetchall())


def test_betweenness_is_of_all_sources(spark, sf_dir):
    whole = {r["id"]: r["score"] for r in catalog.QUERIES["betweenness_all_sources"](spark, sf_dir).collect()}
    most = max(whole.values())
    found = {r["id"]: r["score"] for r in catalog.QUERIES["betweenness"](spark, sf_dir).collect()}
    assert found.keys() == whole.keys() and all(abs(found[i] - whole[i] / most) < 1e-5 for i in whole)
