import os

import duckdb
import pytest

from siltstone import llm

SCHEMAS = {
    "p1_found": {"chunk_id": "string", "kind": "string"}, "p2_found": {"export_id": "string", "line_no": "int"}, "p3_found": {"chunk_id": "string", "cut": "string"},
    "p4_found": {"source_table": "string", "record_id": "string", "kind": "string", "start_at": "int"}, "p5_found": {"service": "string", "activity_class": "string", "pct": "int", "band": "int"},
    "p6_found": {"asset_id": "string"}, "p7_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p8_found": {"doc_id": "bigint", "item_id": "bigint"}, "p9_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_columns_and_no_repeats(spark, sf, name):
    frame = llm.queries()[name](spark, sf)
    assert dict(frame.dtypes) == SCHEMAS[name]
    rows = [str(tuple(r)) for r in frame.collect()]
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    connection = duckdb.connect()
    for file in os.listdir(sf):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    answer = connection.execute(llm.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    got = sorted(tuple(r) for r in llm.queries()[name](spark, sf).select(*names).collect())
    assert got == sorted(answer.fetchall())
