import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import paths as P
from siltstone.functions import scores as SC
from siltstone.functions import text as X
from siltstone.functions import vectors as V


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_text(spark):
    rows = [(" \u00a0a  b\r\nc ",), ("",), (None,), ("x" * 5000,)]
    got = one(spark, rows, "t string", X.strip("t"), X.collapse_space("t"), X.token_estimate("t"), X.newline_normalise("t"))
    assert got[0] == ("a  b\r\nc", "a b c", 3, " \u00a0a  b\nc ")
    assert got[1] == ("", "", 1, "") and got[2] == (None, None, 1, None) and got[3][2] == 1
    assert one(spark, [("Dashboard dashboard RFP status?",)], "t string", X.query_terms("t"))[0][0] == ["dashboard", "rfp", "status"]
    assert one(spark, [("Hello, World -- 2024!",), ("---",), (None,)], "t string", X.slug("t")) == [("hello-world-2024",), ("memory",), ("memory",)]
    assert one(spark, [("ab",)], "t string", X.trigrams("t"))[0][0] == ["  a", " ab", "ab "]
    page = "<html><head><title>t</title></head><script>x()</script><p>a&nbsp;&lt;b&gt;</p><!-- c --></html>"
    assert one(spark, [(page,)], "t string", X.html_text("t")) == [("a <b>",)]


def test_snippets(spark):
    text = "word " * 100 + "watcher here " + "tail " * 100
    got = one(spark, [(text,), ("short watcher",), (None,)], "t string", X.snippet(X.collapse_space("t"), F.lower(X.collapse_space("t")), F.array(F.lit("watcher"))), X.short_snippet(X.collapse_space("t")))
    assert "watcher" in got[0][0] and got[0][0].startswith("...") and got[0][0].endswith("...") and len(got[0][1]) == 281
    assert got[1] == ("short watcher", "short watcher") and got[2] == (None, None)


def test_redaction_is_idempotent(spark):
    key = "sk-" + "a" * 24
    text = f"Use {key} and password = super-secret; then pwd:'x' mail a@b.example token=abc sk-short"
    once = one(spark, [(text,)], "t string", X.redact_secrets("t"))[0][0]
    assert once == "Use [REDACTED:openai_api_key] and password = [REDACTED:password_assignment]; then pwd:'x' mail a@b.example token=abc sk-short"
    assert one(spark, [(once,)], "t string", X.redact_secrets("t"))[0][0] == once
    assert one(spark, [("Token [REDACTED:openai_api_key] remains.",), ("",), (None,)], "t string", X.redact_secrets("t")) == [("Token [REDACTED:openai_api_key] remains.",), ("",), (None,)]
    kept = one(spark, [("password: hunter2 a@b.example token=abc",)], "t string", X.redact_emails("t"), X.redact_assignments("t"))[0]
    assert kept == ("password: hunter2 [REDACTED:email] token=abc", "password: *** a@b.example token=***")


def test_decode(spark):
    rows = [("ä\r\nb".encode(),), (b"\xef\xbb\xbfx",), ("é".encode("utf-16"),), (b"a\xffb",), (None,)]
    assert [r[0] for r in one(spark, rows, "content binary", X.decode_text("content"))] == ["ä\nb", "x", "é", "a\ufffdb", None]


def test_token_hash_embedding(spark):
    vector = H.token_hash_vector("abc")
    assert vector[0x4B] == -1 and math.isclose(sum(v * v for v in vector), 1)
    assert H.token_hash_vector("ＡＢＣ") == vector and math.isclose(sum(v * v for v in H.token_hash_vector("")), 1, rel_tol=1e-6)
    assert one(spark, [(None,), ("abc",)], "t string", H.token_hash_embedding("t"))[0] == (None,)
    assert one(spark, [("Ａ\r\nb",)], "t string", H.nfkc("t")) == [("a\nb",)]


def test_paths(spark):
    rows = [("a\\b\\C.tar.GZ",), ("x",), (".env",), (None,)]
    assert one(spark, rows, "p string", P.leaf("p"), P.stem("p"), P.extension("p"), P.folder("p")) == [("C.tar.GZ", "C.tar", ".gz", "a/b"), ("x", "x", "", ""), (".env", ".env", "", ""), (None, None, None, None)]
    include = P.included("p", ["*.py"], ["tests/", "**/build/**", "!*/keep.py"])
    rows = [("src/a.py",), ("tests/a.py",), ("x/build/b.py",), ("tests/keep.py",), ("a.js",)]
    assert [r[0] for r in one(spark, rows, "p string", include)] == [True, False, False, True, False]
    titles = [("RFP Response v1",), ("RFP Response v2 final",), ("Architecture copy (2)",), ("Architecture",), ("v1",)]
    keys = [r[0] for r in one(spark, titles, "t string", P.family_key("t"))]
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[4] == "v1"
    assert P.effective_globs("extend", ["b", "a"], ["a"]) == ["a", "b"] and P.effective_globs("override", ["b"], ["a"]) == ["b"]
    rows = [(b"%PDF-1",), (b"PK\x03\x04",), (b"plain",), (b"\x00\x01",), (b"",), (b"\xff\xfe\xfd",)]
    assert [r[0] for r in one(spark, rows, "c binary", P.signature_kind("c"))] == ["pdf", "zip", "utf8_text", "unknown", "empty", "unknown"]
    assert one(spark, [("R:\\Data\\x", "r:/data"), ("r:/database", "r:/data")], "p string, r string", P.is_under("p", "r")) == [(True,), (False,)]


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])]
    got = [r[0] for r in one(spark, rows, "a array<double>, b array<double>", V.cosine("a", "b"))]
    assert got[0] == pytest.approx(math.sqrt(0.5)) and got[1:] == [None, None, None]


def test_scores(spark):
    c = F.col
    args = lambda penalty: SC.lifecycle_score(c("conf"), c("age"), c("ca"), F.lit(0.0), c("usage"), F.lit(penalty))
    rows = [(0.9, 10.0, 5.0, 3), (0.9, 10.0, None, 3), (5.0, -3.0, 0.0, 10**6)]
    got = one(spark, rows, "conf double, age double, ca double, usage int", args(1.0), args(0.0))
    assert got[0][0] > got[1][0] and all(r[1] == 0 for r in got) and 0 < got[2][0] <= 1
    assert [r[0] for r in one(spark, [(1,), (4,), (99,)], "n int", SC.backoff(60.0, c("n"), 3600.0))] == [60.0, 480.0, 3600.0]
    assert [r[0] for r in one(spark, [("blocked_x",), ("failed",), ("busy",), ("retrying_1",), ("done",)], "s string", SC.status_group(c("s")))] == ["blocked", "failed", "running", "pending", "completed"]
    assert [r[0] for r in one(spark, [(0,), (256,), (None,)], "n int", SC.range_label(c("n"), [256]))] == ["0-255", "256+", "unknown"]
