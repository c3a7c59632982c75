import random

import numpy as np
import pytest

from siltstone.llm import splitting as S


def brute_runs(text):
    longest = run = 0
    for c in text:
        run = 0 if c.isspace() or c in S.MARKS else run + 1
        longest = max(longest, run)
    return longest


def test_plan_covers_text_and_keeps_overlap():
    offsets = np.array([3900, 7700, 9000])
    pieces = S.plan(offsets, np.array([4, 2, 0]), 9500)
    assert pieces[0][:2] == (0, 3900)
    for (a0, b0, *_), (a1, b1, *_) in zip(pieces, pieces[1:], strict=False):
        assert a1 <= b0 and b0 - a1 <= S.OVERLAP and b1 > b0
    assert pieces[-1][1] == 9500


def test_split_texts(spark):
    rng = random.Random(1)
    words = lambda n: " ".join("x" * rng.randint(1, 12) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    texts = {
        "prose": "\n\n".join(words(80) for _ in range(40)),
        "blob": "a" * 9001,
        "edge": "b" * 4000 + " c",
        "cjk": "文字。" * 3000,
        "huge": words(40_000),
        "small": "c" * 4000,
        "null": None,
        "empty": "",
    }
    frame = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()], "id string, body string, piece_no string")
    rows = S.split_texts(frame, "id", "body").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["piece_no"]):
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {"prose", "blob", "edge", "cjk", "huge"}
    for name, pieces in by.items():
        text = texts[name]
        assert [p["piece_no"] for p in pieces] == list(range(len(pieces)))
        assert pieces[0]["start_at"] == 0 and pieces[-1]["end_at"] == len(text)
        rebuilt = pieces[0]["piece"]
        for before, p in zip(pieces, pieces[1:], strict=False):
            shared = before["end_at"] - p["start_at"]
            assert 0 < shared <= S.OVERLAP
            assert before["piece"][-shared:] == p["piece"][:shared]
            rebuilt += p["piece"][shared:]
        assert rebuilt == text
        assert all(p["piece"] == text[p["start_at"] : p["end_at"]] and len(p["piece"]) <= S.LIMIT for p in pieces)
    cuts = {r["id"]: r["cut"] for r in S.planned(frame.where("length(body) > 4000"), "id", "body").collect()}
    assert cuts == {k: "forced" if brute_runs(texts[k]) > 4000 else "natural" for k in by}
    assert not any(p["forced"] for p in by["prose"] + by["cjk"] + by["huge"])


@pytest.mark.parametrize("seed", range(20))
def test_stitching_ranges_equals_the_whole(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab. \nö文😀" if rng.random() < 0.1 else "abcdeß") for _ in range(rng.randint(1, 400)))
    raw = text.encode()
    planner, offsets = S.Planner(), []
    for number, start in enumerate(range(0, len(raw), 50)):
        lead, core = min(S.HALO, start), min(50, len(raw) - start)
        size, at, strengths, head, tail, inner = S.boundary_table(raw[start - lead : start + core + S.HALO], lead, core)
        offsets += [planner.at + x for x in at]
        planner.take({"number": number, "size": size, "offsets": at, "strengths": strengths, "head": head, "tail": tail, "inner": inner})
    assert (planner.at, planner.longest) == (len(text), brute_runs(text))
    assert all(text[x - 1].isspace() or text[x - 1] in S.MARKS or text[x - 1] in "\"')]" for x in offsets)


def test_streamed_plan_equals_the_whole():
    rng = random.Random(9)
    for _ in range(20):
        sizes = [rng.randint(1, 9000) for _ in range(rng.randint(1, 30))]
        tables = [sorted(rng.sample(range(1, n + 1), rng.randint(0, n // rng.choice([20, 500, 5000])))) for n in sizes]
        strengths = [[rng.randint(0, 4) for _ in t] for t in tables]
        planner, pieces, at, offsets = S.Planner(), [], 0, []
        for number, (n, t, s) in enumerate(zip(sizes, tables, strengths, strict=True)):
            pieces += planner.take({"number": number, "size": n, "offsets": t, "strengths": s, "head": n, "tail": n, "inner": n})
            offsets += [at + x for x in t]
            at += n
            assert len(planner.offsets) <= 4 * S.LIMIT + 9000
        pieces += planner.rest()
        want = S.plan(np.array(offsets, dtype=np.int64), np.array(sum(strengths, []), dtype=np.int64), at) if at > S.LIMIT else []
        assert [p[:3] for p in pieces] == [p[:3] for p in want]
        begins = np.cumsum([0, *sizes])
        assert all(begins[number] + local == a and local < sizes[number] for a, _, _, number, local in pieces)


def test_files_are_split_by_byte_ranges(spark, tmp_path):
    rng = random.Random(3)
    text = " ".join(rng.choice(["wört", "文字。", "plain", "😀", "end.\n\n"]) for _ in range(60_000))
    (tmp_path / "big.txt").write_text(text, newline="")
    (tmp_path / "none.txt").write_text("")
    (tmp_path / "small.txt").write_text("x y")
    rows = sorted(S.split_files(spark, str(tmp_path), step=10_001).collect(), key=lambda r: r["piece_no"])
    assert {r["path"].rpartition("/")[2] for r in rows} == {"big.txt"} and [r["piece_no"] for r in rows] == list(range(len(rows)))
    assert rows[0]["start_at"] == 0 and rows[-1]["end_at"] == len(text)
    assert all(r["piece"] == text[r["start_at"] : r["end_at"]] and len(r["piece"]) <= S.LIMIT for r in rows)
    assert all(0 < a["end_at"] - b["start_at"] <= S.OVERLAP for a, b in zip(rows, rows[1:]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id string, body string")
    assert S.split_texts(empty, "id", "body").count() == 0
