"""Training-data queries with SQL give the rows that DuckDB gives, on the smallest tables; the others run."""

import os
from collections import Counter

import pytest

from quillstone.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    return connection


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    want = Counter(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    QUERIES[name](spark, FOLDER).count()
