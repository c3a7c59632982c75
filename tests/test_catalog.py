"""Every query with SQL must agree with it on the smallest tables."""

import importlib
import os
import sys

import duckdb
import pytest

from siltstone.plans import catalog


def normal(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    return value


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in sorted(os.listdir(sf)):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    frame = catalog.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(normal(v) for v in row)) for row in frame.select(*columns).collect())
    answer = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(normal(row[i]) for i in at)) for row in answer.fetchall())


def test_entry_without_the_optional_subpackage(monkeypatch):
    monkeypatch.syspath_prepend(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.setattr(entry, "_training_data", lambda: None)
    assert set(entry.queries()) == set(catalog.queries()) and not any(n.startswith("p1_") for n in entry.oracle_sql())


def test_entry_runs(spark, sf):
    assert catalog.queries()["search_brief"](spark, sf).count() > 0
