import os
import random

import pytest

from siltstone.llm import tokenizing as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.read_vocabulary(), special_tokens={})


def test_merges_equal_an_independent_library(reference):
    encoder = T.Encoder(T.read_vocabulary())
    rng = random.Random(5)
    texts = ["", " ", "Hello world's  tests\n\n\tx", "<|endoftext|>", "naïve Größe 東京 😀​", "a" * 3000, "=" * 700 + "ab" * 900, "\x00�"]
    texts += ["".join(rng.choice("abcdeé 01_-\n") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    texts.append("".join(rng.choice("etaoinsh") for _ in range(20_000)))
    for text in texts:
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_token_ids(spark, reference, sf):
    frame = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "  x", "c"), (3, "  x", "c")], "doc_id long, text string, ids string")
    rows = sorted(map(tuple, T.token_ids(frame).collect()))
    assert rows == [(1, None), (2, []), (3, reference.encode_ordinary("  x")), (3, reference.encode_ordinary("  x"))]
    assert T.token_ids(frame.limit(0)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in T.p7_ids(spark, sf).collect():
        text = texts[r["doc_id"]]
        assert r["ids"] == (None if text is None else reference.encode_ordinary(text))


def test_control_characters_and_another_vocabulary(spark, reference):
    encoder = T.Encoder(T.read_vocabulary())
    for text in ("a\x1cb \x1d\x1e x\x1f", "\t\n\x0b\x0c\r  y\x85z", "it's I'LL 12a_b  ", "x y"):
        assert encoder.encode(text) == reference.encode_ordinary(text)
    import tiktoken

    other = os.path.join(os.path.dirname(T.VOCABULARY), "byte_bpe_multi_50k.tiktoken")
    want = tiktoken.Encoding("other", pat_str=r"\S+|\s+", mergeable_ranks=T.read_vocabulary(other), special_tokens={})
    texts = ["Größe 東京", "plain words", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in T.token_ids(frame, vocabulary=other, pattern=r"\S+|\s+").collect()} == {i: want.encode_ordinary(t) for i, t in enumerate(texts)}
