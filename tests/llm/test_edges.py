"""Every query over tables with nulls in any column, repeated rows, ties, very long texts and further columns, and over empty tables."""

import datetime as dt

import pytest

from siltstone import llm

TABLES = "asset_chunks source_assets code_symbols episodes parsed_email model_activity_events documents eval_items".split()
EXTRA = "kind line cut pieces n value rank score term word bucket set_id version spans changes part off".split()
LONG = {"asset_chunks": "body", "episodes": "summary", "parsed_email": "text_body", "documents": "text", "eval_items": "passage"}


def rows_of(frame, name):
    """A few rows, one with nulls beside the key, one of nulls only, repeats, and a very long text."""
    kept = [tuple(r) for r in frame.limit(12).collect()]
    fields = frame.columns
    key = next(f for f in ("id", "export_id", "doc_id", "item_id") if f in fields)
    wide = {"id": "edge-null", "export_id": "edge-null", "doc_id": 10**9, "item_id": 10**9}
    null = tuple(wide[key] if f == key else None for f in fields)
    rows = [*kept, *kept[:2], null, null, tuple(None for _ in fields)]
    if name in LONG:
        at = fields.index(LONG[name])
        for number, text in enumerate(["", "  \n\t ", "word " * 60_000, "x" * 50_000, " " * 50_000 + ".", "a-\n" * 5_000, "@" * 2_000 + "+1 " + "2" * 3_000]):
            row = list(kept[number % len(kept)])
            row[at] = text
            row[fields.index(key)] = f"edge-{number}" if isinstance(row[fields.index(key)], str) else 10**9 + 1 + number
            if name == "asset_chunks":
                row[fields.index("modality")] = "ocr"
                row[fields.index("updated_at")] = dt.datetime(2024, 1, 1)
            rows.append(tuple(row))
    return rows


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    dirty, empty = (str(tmp_path_factory.mktemp(n)) for n in ("dirty", "empty"))
    for name in TABLES:
        frame = spark.read.parquet(f"{sf}/{name}.parquet")
        dirtied = spark.createDataFrame(rows_of(frame, name), frame.schema)
        for extra in EXTRA:
            if extra not in frame.columns:
                dirtied = dirtied.selectExpr("*", f"'clash' as {extra}")
        dirtied.coalesce(1).write.parquet(f"{dirty}/{name}.parquet")
        frame.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return {"dirty": dirty, "empty": empty}


@pytest.mark.parametrize("name", sorted(llm.queries()))
@pytest.mark.parametrize("folder", ["dirty", "empty"])
def test_query_survives(spark, folders, name, folder):
    rows = llm.queries()[name](spark, folders[folder]).collect()
    if folder == "empty":
        assert rows == []
    elif name.endswith("_found"):
        assert len(rows) == len({str(tuple(r)) for r in rows})
        assert all(r[0] is not None for r in rows if name not in ("p5_found",))
