from siltstone.llm import spam_pages as S

PROSE = "The crawler restarted at noon and needed two minutes. Nobody could verify the rows because the folder was renamed. We decided to keep the older ranking for now. "


def test_kinds_of_spam():
    spam = [
        "Cheap lamp shop online. Best lamp shop here. Buy lamp shop now. Top lamp shop offer. Free lamp shop 2024. New lamp shop tool. ",
        "\n".join(f"- [Read more](https://a.example/{i})" for i in range(9)),
        "\n".join(f"Pricing https://a.example/{i} lamp shop" for i in range(9)),
        "\n".join(f"SKU {i} Lamp Shop Pro {i}.99 sale" for i in range(10, 20)),
        "lamp shop; oil lamp; desk light; lamp shop; oil lamp; desk light; lamp shop",
        "#LampShop #OilLamp #DeskLight #LampShop #OilLamp",
        "lamp shop the lamp shop crawler lamp shop restarted lamp shop lamp shop at lamp shop noon lamp shop",
    ]
    for text in spam:
        assert S.spam_share(text) > S.SHARE, text
        assert S.spam_share(PROSE * 2 + "\n\n" + text[: len(PROSE)]) <= S.SHARE
    plain = [
        PROSE,
        "| case | ms |\n| --- | --- |\n" + "\n".join(f"| a-{i} | {i}.50 |" for i in range(20)),
        "\n".join(f"2024-01-01T00:00:0{i}Z INFO crawler root=a n={i}" for i in range(9)),
        PROSE + "Source: https://a.example/x, see also https://b.example/y",
        # full, differing statements that share their subject
        " ".join(f"Lamp shop {v} {w}." for v, w in (("keeps", "a longer debounce after the folder was renamed"), ("lacks", "a second reviewer until the queue drained"), ("needs", "one retry because the lease had expired"), ("requires", "a read-only mount while the archive was unpacked"), ("keeps", "a smaller batch since nothing useful returned"), ("needs", "the older ranking before the snapshot had finished"))),
        "", "   ", "ok",
    ]
    for text in plain:
        assert S.spam_share(text) <= S.SHARE, text


def test_rows(spark):
    link = "\n".join(f"https://a.example/{i}" for i in range(5))
    rows = [(1, None, "x"), (2, "", "x"), (3, link, "x"), (3, link, "x"), (None, PROSE, "x"), (5, "word " * 200_000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, share string")
    found = sorted((r["doc_id"] or 0, r["share"] > S.SHARE) for r in S.spam_pages(frame).collect())
    assert found == [(0, False), (1, False), (2, False), (3, True), (3, True), (5, True)]
    assert S.spam_pages(frame.limit(0)).count() == 0


def test_spam_of_many_shapes():
    from siltstone.llm.spam_pages import spam_share

    lines = [" ".join(["see", "more", "about", "lamps", "and", "rings"][:k]) + " https://shop.example/x" * n for n in (1, 2, 3) for k in range(1, 7)]
    assert spam_share("\n".join(lines)) > 0.95
