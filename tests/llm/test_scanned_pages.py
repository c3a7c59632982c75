import datetime as dt
import random

from siltstone.llm import scanned_pages as S

SENTENCES = [
    "The crawler should never rotate the archived trust ranks.",
    "Nobody could verify the remaining policies after the restart.",
    "The evidence trail depends on a long-term archive tier.",
    "Readers of the brief inspect the calendar rows at noon.",
]
SCHEMA = "id string, asset_id string, modality string, locator string, body string, updated_at timestamp_ntz, kind string"


def test_candidates():
    assert "depth" in S.candidates("dcpth") and "remaining" in S.candidates("rem@ining") and "claim" in S.candidates("clairn")
    assert "fallback" in S.candidates("fall6ack") and "review" in S.candidates("revievv") and "duplicated" in S.candidates("duphcated")
    assert not S.correctable("331ae72897") and not S.correctable("42")


def test_layout():
    page = S.layout("7    Amber Archive Report\nThe finger-\n\n- 3 -\n\fprint was read. A long-\nterm tier.\n\nTotal\n523\nSum\n486\n\nviii")
    assert page.page_lines == {3, 12} and page.sides == {0} and set(page.titles) == {0}
    assert page.breaks[1][:3] == ("finger", "-", 4) and page.breaks[4][2:] == (5, "term")
    assert S.fold("AMBER Archive Report") == S.fold("12    Am6er Arcliive Repor†")
    assert S.layout("").page_lines == set()


def build(rng, dirt):
    body = " ".join(rng.choice(SENTENCES) for _ in range(6))
    for a, b in dirt:
        body = body.replace(a, b, 1)
    words, lines, line = body.split(" "), [], ""
    for w in words:
        if len(line) + len(w) > 44:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


def test_found_and_repaired(spark, tmp_path):
    rng = random.Random(1)
    when = dt.datetime(2024, 1, 1)
    rows = [(f"c{i}", f"a{i % 20}", "ocr", "page:1", build(rng, []), when, "x") for i in range(120)]
    clean = rows[0][4]
    rows += [
        ("misread", "m", "ocr", None, clean.replace("The ", "Thc crawlcr and the ", 1) + "\nNobody could vcrify the remaining po|icies.", when, "x"),
        ("soft", "m", "text", "page:2", "The craw\xad\nler should never rotate the archived trust ranks.", when, "x"),
        ("dash", "m", "ocr", "page:3", "The craw-\nler should never rotate the archived trust ranks.", when, "x"),
        ("compound", "m", "ocr", "page:4", "The evidence trail depends on a long-\nterm archive tier.", when, "x"),
        ("end", "m", "ocr", "page:5", "The evidence trail depends on the craw-", when, "x"),
        ("h1", "h", "ocr", "page:1", "3    Amber Ledger Report\n" + clean, when, "x"),
        ("h2", "h", "ocr", "page:2", "AMBER LEDGER REPORT\n\n" + clean + "\n\n[4]", when, "x"),
        ("once", "o", "ocr", "page:2", "Single Title Line\n\n" + clean, when, "x"),
        ("null", "m", "ocr", "page:9", None, when, "x"), ("blank", "m", "ocr", "page:9", "", when, "x"),
        ("code", "m", "code", "lines:1", "x po|icies", when, "x"),
        ("again", "m", "ocr", "page:1", "old\n\n7", when, "x"), ("again", "m", "ocr", "page:1", clean, dt.datetime(2024, 2, 1), "x"),
        ("long", "l", "ocr", "page:1", (clean + "\n") * 300, when, "x"),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/asset_chunks.parquet")
    found = {(r["chunk_id"], r["kind"]) for r in S.p1_found(spark, str(tmp_path)).collect()}
    expected = {("misread", "misread"), ("soft", "hyphen"), ("dash", "hyphen"), ("end", "hyphen"), ("h1", "header"), ("h1", "page_no"), ("h2", "header"), ("h2", "page_no")}
    assert found == expected
    text = {r["chunk_id"]: r["body"] for r in S.p1_text(spark, str(tmp_path)).collect()}
    assert text["dash"] == text["soft"] == "The crawler should never rotate the archived trust ranks."
    assert text["compound"] == "The evidence trail depends on a long-term archive tier."
    assert text["h2"] == text["h1"] == clean.replace("\n", " ")
    assert "policies" in text["misread"] and "verify" in text["misread"] and text["blank"] == ""


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/asset_chunks.parquet")
    assert S.p1_found(spark, str(tmp_path)).count() == 0


def test_misread_words_of_a_copied_page_and_of_rare_words(spark, tmp_path):
    rng = random.Random(2)
    when = dt.datetime(2024, 1, 1)
    rows = [(f"c{i}", f"a{i % 20}", "ocr", "page:1", build(rng, []), when, "x") for i in range(60)]
    copied = "Nobody could vcrify the remaining policies after the restart."
    rows += [(f"copy{i}", f"b{i}", "ocr", "page:1", copied, when, "x") for i in range(30)]
    rare = "The zeppelin rotates at noon."
    rows += [("r1", "r1", "ocr", "page:1", rare, when, "x"), ("r2", "r2", "ocr", "page:1", rare + " Then the zeppelin stays.", when, "x"), ("r3", "r3", "ocr", "page:1", rare.replace("zeppelin", "zeppe!in"), when, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/asset_chunks.parquet")
    found = {r["chunk_id"] for r in S.p1_found(spark, str(tmp_path)).collect() if r["kind"] == "misread"}
    assert found == {f"copy{i}" for i in range(30)} | {"r3"}
