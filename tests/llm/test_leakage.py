import random

from siltstone.llm import leakage as L


def brute(texts, passages, shared=13):
    found = set()
    for doc, text in texts:
        words = L.words_of(text or "")
        for item, passage in passages:
            want = L.words_of(passage or "")
            size = min(shared, len(want))
            grams = {tuple(want[i : i + size]) for i in range(len(want) - size + 1)} if want else set()
            if any(tuple(words[i : i + size]) in grams for i in range(len(words) - size + 1)):
                found.add((doc, item))
    return found


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(6)] + ["Ünï", "x_y"]
    passages = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for i in range(25)] + [(100, None), (101, "..."), (102, "Solo"), (103, "two words")]
    texts = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    for i in range(40):
        source = rng.choice(passages)[1] or ""
        words = source.split()
        at = rng.randint(0, max(0, len(words) - 13))
        texts.append((1000 + i, f"pre fix, {'; '.join(words[at : at + rng.choice([12, 13, 14])]).upper()} end"))
    texts += [(2000, None), (2001, ""), (2002, "SOLO!"), (2003, "two-Words"), (2003, "two-Words")]
    docs = spark.createDataFrame([(d, t, 7) for d, t in texts], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(passages, "item_id long, passage string")
    expected = brute(texts, passages)
    assert len(expected) > 40
    for block in (L.BLOCK_BYTES, 500):
        rows = [tuple(r) for r in L.leaks(docs, items, block_bytes=block).collect()]
        assert sorted(rows) == sorted(expected)
    assert L.leaks(docs.limit(0), items).count() == 0
    assert L.leaks(docs, items.limit(0)).count() == 0


def test_on_tables(spark, sf):
    read = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(*c).collect()]
    assert {tuple(r) for r in L.p8_found(spark, sf).collect()} == brute(read("documents", "doc_id", "text"), read("eval_items", "item_id", "passage"))


def test_a_passage_that_repeats_itself():
    """Runs that come back within a passage are one pattern, so a long repetition takes time in proportion to its length."""
    matcher = L.WuManber([(1, "word " * 60_000), (2, "word " * 20), (3, "a b " * 30)])
    assert len(matcher.tables[0].starts) == 4
    assert matcher.items_in(["word"] * 20_000) == {1, 2} and matcher.items_in(["a", "b"] * 7) == {3} and matcher.items_in(["word"] * 12) == set()
