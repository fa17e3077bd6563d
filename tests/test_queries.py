"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import datetime
import math
import os
import sys
from collections import Counter

import pytest

import __spark_entry__
from quillstone.plans import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for file in os.listdir(FOLDER):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return str(value.astimezone(datetime.timezone.utc).replace(tzinfo=None) if value.tzinfo else value)
    return value


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
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_a_stable_schema(spark):
    assert __spark_entry__.entry(spark).columns == ["product_id", "seq", "log_pos"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "quillstone.llm", None)
    monkeypatch.delitem(sys.modules, "quillstone.llm.queries", raising=False)
    assert set(__spark_entry__.queries()) == set(QUERIES)
