import os

import duckdb
import pytest

import __spark_entry__ as entry
from tavola.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(_plain, value)) if isinstance(value, list | tuple) else value


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_id", "r_id", "score"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rows = sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    sql = oracle.oracle_sql().get(name)
    if sql is None:
        return
    got = duck.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(df.columns)]
    assert rows == sorted((tuple(_plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
