import pytest
from pyspark.sql import functions as F

from siltstone.operators import requests as R


def test_requests():
    assert R.request({"query": " a ", "kinds": ["Mail", "mail", " file"]}) == R.Request("a", kinds=("file", "mail"))
    assert R.values(["B-c", "", "a", "b_c"]) == ("a", "b_c") and R.values(None) == ()
    for bad in ({}, {"query": " "}, {"query": "a", "limit": 51}, {"query": "a", "scope": "all"}, {"query": "a", "kinds": ["x"]}, {"query": "a", "file_kinds": ["code", "text"]}):
        with pytest.raises(ValueError):
            R.request(bad)


def test_predicate(spark):
    rows = spark.createDataFrame([("code", True), ("text", False), (None, None), ("text", True)], "file_kind string, gen boolean")
    assert rows.where(R.predicate(R.request({"query": "a"}))).count() == 3
    assert rows.where(R.predicate(R.request({"query": "a", "file_kinds": "code"}))).count() == 1
    assert rows.where(R.predicate(R.request({"query": "a", "include_generated": False}), generated="gen")).count() == 2


def test_a_cursor_belongs_to_its_filter(spark):
    one, same, other = {"status": "busy, failed", "root": []}, {"root": None, "status": ["failed", "busy", "busy"]}, {"status": "busy"}
    cursor = R.cursor("2024-01-01 00:00:00", 7, one)
    assert R.position(cursor, same) == ("2024-01-01 00:00:00", 7)
    for broken in (cursor, "x", "", "2024|a|" + R.fingerprint(other)):
        with pytest.raises(ValueError):
            R.position(broken, other)
    rows = spark.createDataFrame([(1, "busy"), (2, "Busy"), (3, None), (4, "failed")], "id int, status string").withColumn("root", F.lit("r"))
    assert [r["id"] for r in rows.where(R.matches(one)).collect()] == [1, 4] and rows.where(R.matches({"status": []})).count() == 4
