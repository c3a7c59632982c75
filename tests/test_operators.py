import datetime as dt
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators import code as C
from siltstone.operators import graph as G
from siltstone.operators import measures as M
from siltstone.operators import queues as Q
from siltstone.operators import search as S
from siltstone.operators import similarity as D
from siltstone.operators.rerank import overlap, rerank
from siltstone.tables import latest


def test_latest(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("a", 2, "y"), (None, 1, "n"), ("b", None, "z")]
    frame = spark.createDataFrame(rows, "id string, at int, `v.w` string")
    assert {tuple(r) for r in latest(frame, "id", "at").collect()} == {("a", 2, "y"), (None, 1, "n"), ("b", None, "z")}
    assert latest(frame.limit(0), "id", "at").count() == 0


def test_rrf_golden(spark):
    streams = {"lexical": ["a", "b", "c"], "vector": ["b", "d", "a"], "graph": ["e", "b"]}
    rows = [(s, i, n) for s, ids in streams.items() for n, i in enumerate(ids, 1)]
    fused = S.reciprocal_rank_fusion(spark.createDataFrame([*rows, rows[0]], "stream string, doc_id string, rank int"))
    ranked = [tuple(r) for r in fused.orderBy(F.desc("score"), "doc_id").collect()]
    assert ranked[0][0] == "b" and len(ranked) == 5 and ranked[0][2] == ["graph", "lexical", "vector"]
    assert ranked[0][1] == pytest.approx(1 / 62 + 1 / 61 + 1 / 62)
    assert S.reciprocal_rank_fusion(spark.createDataFrame([], "stream string, doc_id string, rank int")).count() == 0


def test_packing_golden(spark):
    rows = [("high", "high", "one two three", 0.9), ("long", "long", "w " * 50, 0.8), ("low", "low", "one two", 0.1)]
    packed = S.pack(spark.createDataFrame(rows, "doc_id string, title string, body string, score double"), 9)
    assert [(r["doc_id"], r["status"]) for r in packed.orderBy("position").collect()] == [("high", "packed"), ("long", "over_budget"), ("low", "packed")]
    nulls = S.pack(spark.createDataFrame([(1, None, None, None)], "doc_id int, title string, body string, score double"), 9)
    assert [r["status"] for r in nulls.collect()] == ["packed"]


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    vocab = "alpha beta gamma delta watcher queue".split()
    texts = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30)))) for i in range(40)] + [(100, None), (101, ""), (102, "…")]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id int, text string, term string")
    queries = spark.createDataFrame([(1, "Alpha queue"), (2, "zeta"), (3, None)], "query_id int, query string")
    import math
    import re

    tokens = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in texts if t is not None}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    expected = {}
    for i, ts in tokens.items():
        for term in ("alpha", "queue"):
            df, tf = sum(term in x for x in tokens.values()), ts.count(term)
            if tf:
                expected[i] = expected.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
    got = {r["doc_id"]: r["score"] for r in S.bm25(docs, queries).collect()}
    assert got == pytest.approx(expected)
    top = S.top_k(S.bm25(docs, queries), 3).collect()
    assert [r["rank"] for r in sorted(top, key=lambda r: r["rank"])] == [1, 2, 3]


def test_knn_blocks_agree(spark):
    rng = random.Random(2)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(98, None), (99, [0.0] * 8)], "vec_id int, embedding array<double>")
    asked = v.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    as_set = lambda f: {tuple(r)[:2] for r in f.collect()}
    assert as_set(S.knn(v, asked, 4)) == as_set(S.knn(v, asked, 4, block_rows=2))
    best = {r["query_id"]: r["vec_id"] for r in S.knn(v, asked, 1).collect()}
    assert best == {i: i for i in range(5)}


def test_trigram_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocab = "red reed blue bluer bolt bolts aaaa aaaaa x 42".split()
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 4))) for _ in range(80)]
    rows = [*enumerate(texts + ["Bolt, RED", "red-bolt", None, "", "…"]), (None, texts[0]), (3, texts[3]), (3, texts[4])]
    names = spark.createDataFrame(rows, "k int, name string").repartition(3)
    asked = names.where("k % 3 = 0").selectExpr("k AS q", "name AS query")

    def grams(text):
        return {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", (text or "").lower()) for i in range(len(w) + 1)}

    pairs = {}
    for q, query in rows:
        for k, name in rows if q is not None and q % 3 == 0 else ():
            a, b = grams(query), grams(name)
            if a & b and (score := round(len(a & b) / len(a | b), 6)) >= 0.3:
                pairs.setdefault(q, []).append((-score, k is None, k))
    expected = sorted((q, i + 1, k, -s) for q, found in pairs.items() for i, (s, _, k) in enumerate(sorted(found, key=lambda x: (x[:2], x[2] or 0))[:7]))
    assert any(k is None for q, _, k, _ in expected) and {q: len(x) for q, x in pairs.items()}[3] > 14
    for block, waiting, piece in ((20_000, 1_000_000, 1 << 30), (5, 3, 100)):
        monkeypatch.setattr(S, "WAITING_PAIRS", waiting)
        monkeypatch.setattr(S, "PIECE_PAIRS", piece)
        got = S.trigram_search(names, asked, "k", "name", "q", "query", 0.3, 7, block_rows=block)
        assert sorted((r["q"], r["rank"], r["k"], r["score"]) for r in got.collect()) == expected
    assert S.trigram_search(names.limit(0), asked, "k", "name", "q", "query", 0.3, 7).count() == 0
    assert S.trigram_search(names, asked.limit(0), "k", "name", "q", "query", 0.3, 7).count() == 0


def test_trigram_search_of_many_equal_names(spark):
    """Fails by time where every query meets every name: 100,000 names against 1,000 of them are 10^8 pairs."""
    names = spark.range(100_000).selectExpr("id AS k", "element_at(array('red bolt', 'bolt red', 'Red bolts', 'old plate'), CAST(id % 4 AS INT) + 1) AS name")
    asked = names.where("k % 100 = 0").selectExpr("k AS q", "name AS query")
    began = time.monotonic()
    got = S.trigram_search(names, asked, "k", "name", "q", "query", 0.3, 20).collect()
    assert time.monotonic() - began < 60
    assert sorted((r["rank"], r["k"], r["score"]) for r in got if r["q"] == 500) == [(i + 1, 4 * (i // 2) + i % 2, 1.0) for i in range(20)] and len(got) == 20_000


def test_exact_duplicates_and_collapse(spark):
    frame = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, ""), (6, "")], "doc_id int, text string")
    assert {tuple(r) for r in D.exact_duplicates(frame, "doc_id", "text").collect()} == {(1, 1, 1), (3, 1, 1), (2, 2, 0), (5, 5, 1), (6, 5, 1)}
    results = spark.createDataFrame([("c1", "f", 500, 0.91, "p1"), ("c2", "f", 900, 0.89, "p2"), ("c3", "g", 1, 0.1, "p3")], "id string, fam string, trust int, score double, path string")
    kept = S.collapse_versions(results, F.col("fam"), "id", "trust", "score", "path")
    assert {(r["id"], r["suppressed"]) for r in kept.collect()} == {("c2", 1), ("c3", 0)}


def test_cosine_pairs_are_complete(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in base[i % 12]], i % 2) for i in range(60)] + [(900, [0.0] * 6, 0), (901, None, 0)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    expected = {(a[0], b[0]) for a, b in itertools.combinations(rows[:60], 2) if a[2] == b[2] and cosine(a[1], b[1]) >= 0.95}
    assert {(r["a"], r["b"]) for r in D.cosine_pairs(frame, 0.95).collect()} == expected and expected


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)] + [(500, 500), (600, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    expected = {x: find(x) for x in list(parent)}
    assert {r["node"]: r["component"] for r in D.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()} == expected


def test_traverse(spark):
    edges = spark.createDataFrame([("a", "b", "k"), ("b", "c", "k"), ("c", "a", "k"), ("a", "c", "other"), ("c", "d", "k")], "src string, dst string, kind string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["depth"]) for r in G.traverse(edges, start, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {(r["node"], r["depth"], *r["path"]) for r in G.traverse(edges, start, 2, kinds=["k"]).collect()} == {("a", 0, "a"), ("b", 1, "a", "b"), ("c", 2, "a", "b", "c")}


def test_queues(spark):
    jobs = spark.createDataFrame([("a", i, i % 3, 10 - i) for i in range(6)] + [("b", 10, 9, 1)], "fam string, id int, pri int, at int")
    running = spark.createDataFrame([("a", 1)], "fam string, id int")
    got = [r["id"] for r in Q.claim(jobs, running, "fam", "id", "pri", "at", 3, 10).orderBy(F.desc("pri"), "at").collect()]
    assert got == [10, 5, 2]
    events = spark.createDataFrame([("k", t, t) for t in (0, 1, 5, 6, 11)], "k string, t long, id int")
    assert sorted(r["id"] for r in Q.accepted(events, ["k"], F.col("t"), "id", 5).collect()) == [0, 5, 11]
    merged = Q.upsert(spark.createDataFrame([("a", 1, "old"), ("b", 5, "stay")], "k string, v int, x string"), spark.createDataFrame([("a", 1, "new"), ("c", 1, "add"), ("b", 4, "late")], "k string, v int, x string"), ["k"], "v")
    assert {(r["k"], r["x"]) for r in merged.collect()} == {("a", "new"), ("b", "stay"), ("c", "add")}
    seen = spark.createDataFrame([("s", 1, "h1"), ("s", 2, "h1"), ("s", 3, "h2")], "s string, t int, h string")
    assert [(r["event"], r["revision"]) for r in Q.revisions(seen, ["s"], [F.asc("t")], F.col("h")).orderBy("t").collect()] == [("added", 1), ("unchanged", 1), ("updated", 2)]


def test_measures(spark):
    cases = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["x"]), (["a"], [])], "o array<string>, e array<string>")
    got = [tuple(r) for r in cases.select(*M.retrieval_measures(F.col("o"), F.col("e")).values()).collect()]
    assert got[0] == pytest.approx((0.0, 1.0, 1.0, 0.5, 0.6309297535714575)) and got[1] == got[2] == (0, 0, 0, 0, 0)
    rows = spark.createDataFrame([("x", "r1"), ("y", "r1"), ("x", "r2"), (None, "r1")], "status string, root string")
    found = {tuple(r) for r in M.facets(rows, {"status": ["x"], "root": ["r1"]}).collect()}
    assert found == {("status", "x", 1), ("status", "y", 1), ("root", "r1", 1), ("root", "r2", 1)}
    root = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1,), (1,)], "p int")
    assert {tuple(r) for r in M.branch_counts(root, "k", {"a": (child, "p"), "b": (child, "p")}).collect()} == {(1, 2, 2), (2, 0, 0)}


def test_code(spark):
    text = "import os\n\nclass A:\n    def f(self):\n        return g(1)\n\nasync def h():\n    f(2); f(3)\n"
    assert [(s[2], s[4], s[5]) for s in C.symbols_of("a/x.py", text)] == [("class", "A", 3), ("method", "A.f", 4), ("function", "h", 7)]
    assert [s[6] for s in C.symbols_of("x.py", "def a(:\n  pass")] == ["fallback"]
    assert [s[4] for s in C.symbols_of("x.go", "package a\nfunc (s *T) Run(x int) {\n}\ntype T struct {")] == ["Run", "T"]
    assert [s[4] for s in C.symbols_of("x.ts", "export const f = (a) => 1\nexport class K {}\nfunction z() {}")] == ["f", "K", "z"]
    assert [s[4] for s in C.symbols_of("x.cs", "public sealed class A\n{\n    public int F(int a)\n")] == ["A", "F"]
    assert C.symbols_of("x.bin", None) == []
    refs = C.references_of("a/x.py", text)
    assert ("a/x.py", "import", "os", 1, None) in refs and ("a/x.py", "call", "f", 8, "h") in refs and len([r for r in refs if r[2] == "f"]) == 1
    frame = spark.createDataFrame([("a.py", text, "k"), (None, text, "k"), ("b.py", None, "k")], "path string, text string, kind string")
    assert C.code_symbols(frame).count() == 3 and C.code_references(frame).count() == len(refs)


def test_rerank(spark):
    rows = [(1, "red fox", i, t, i) for i, t in enumerate(["nothing", "a red fox", "red", None], 1)]
    frame = spark.createDataFrame(rows, "query_id int, query string, doc_id int, text string, rank int")
    assert [r["doc_id"] for r in rerank(frame, overlap, batch=2).orderBy("rank").collect()] == [2, 3, 1, 4]
    assert [r["doc_id"] for r in rerank(frame, overlap, deadline_s=-1.0).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_equal_vectors_keep_all_their_pairs(spark):
    rows = [(5, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (9, [1.0, 0.0], 0), (3, [0.99, 0.05], 0), (4, [0.0, 1.0], 0), (7, [0.0, 1.0], 0), (8, [1.0, 0.0], 1), (1, [1.0, 0.0], None), (6, [1.0, 0.0], None)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")
    found = [(r["a"], r["b"]) for r in D.cosine_pairs(frame, 0.95).collect()]
    assert sorted(found) == [(2, 3), (2, 5), (2, 9), (3, 5), (3, 9), (4, 7), (5, 9)]
    parts = {r["node"]: r["component"] for r in D.connected_components(D.cosine_links(frame, 0.95)).collect()}
    assert parts == {2: 2, 3: 2, 5: 2, 9: 2, 4: 4, 7: 4}


def test_running_total_over_partitions(spark):
    rng = random.Random(8)
    rows = [(i, rng.randint(0, 9), rng.choice([None, 1, 2, 5])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, place int, n long")
    found = {r["id"]: r["before"] for r in M.running_total(frame, ["place", "id"], "n").collect()}
    total, want = 0, {}
    for i, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = total
        total += n or 0
    assert found == want and M.running_total(frame.limit(0), ["place", "id"], "n").count() == 0


def test_debounce_of_a_hot_key(spark):
    """One key holds nine tenths of the rows; its runs are taken apart and give what one fold would give."""
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("abc"), rng.randint(0, 20_000), i) for i in range(6000)] + [(None, 5, 9001), (None, 6, 9002), ("a", None, 9003)]
    frame = spark.createDataFrame(rows, "key string, t long, id long")
    want = set()
    for key in {k for k, _, _ in rows}:
        last = None
        for t, i in sorted((t, i) for k, t, i in rows if k == key and t is not None):
            if last is None or t - last >= 7:
                last = t
                want.add((key, i))
    assert {tuple(r) for r in Q.accepted(frame, ["key"], F.col("t"), "id", 7).collect()} == want
    assert Q.accepted(frame.limit(0), ["key"], F.col("t"), "id", 7).count() == 0


def test_pairs_of_a_hot_label_are_spread(spark):
    """Nine tenths of the vectors share a label; tiles meet by name, so no task holds all of them, and no pair is lost."""
    import numpy as np

    rng = np.random.RandomState(3)
    points = rng.normal(size=(1500, 8))
    rows = [(i, [float(x) for x in v], 0 if i % 10 else 1) for i, v in enumerate(points)]
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    want = {(i, j) for i, j in zip(*np.nonzero(close), strict=True) if i < j and (i % 10 == 0) == (j % 10 == 0)}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {(r["a"], r["b"]) for r in D.cosine_pairs(frame, 0.9).collect()} == want and len(want) > 100


def test_sweep_from_close_pairs(spark):
    pairs = spark.createDataFrame([(0.99, True), (0.9, False), (0.86, True), (0.5, True), (0.4, False), (0.1, False)], "s double, dup boolean")
    whole = {tuple(r) for r in M.threshold_sweep(pairs, "s", "dup", [0.82, 0.9, 1.0]).collect()}
    assert {tuple(r) for r in M.sweep_from(pairs.where("s >= 0.82"), "s", "dup", (3, 3), [0.82, 0.9, 1.0]).collect()} == whole


def test_bounds_and_schedules(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "lane string, at int")
    assert sorted((r["lane"], r["at"]) for r in Q.bounded(rows, ["lane"], [F.asc("at")], 2).where("not taken").collect()) == [("a", 3)]
    last = spark.createDataFrame([("x", 0), ("y", 95), ("z", None)], "name string, last long")
    assert {(r["name"], r["missed"]) for r in Q.due(last, F.col("last"), F.lit(100), 10).collect()} == {("x", 9), ("z", 0)}
