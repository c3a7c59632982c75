import datetime as dt

from siltstone.streaming import stateful as T

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, tmp_path, batches, schema, build, name, mode="append"):
    """Feeds one file per batch and gives all rows that came out."""
    source, n = tmp_path / f"in-{name}", 0
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    try:
        for rows in batches:
            n += 1
            staged = tmp_path / f"stage-{name}-{n}"
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(staged))
            for part in staged.glob("part-*"):
                part.rename(source / f"{n:03}.parquet")
            query.processAllAvailable()
    finally:
        query.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_debounce(spark, tmp_path):
    batches = [[("k", at(0)), ("k", at(1)), ("j", at(1))], [("k", at(4)), ("k", at(6)), ("k", at(12))]]
    got = run(spark, tmp_path, batches, "key string, at timestamp", lambda s: T.debounce(s, "key", "at", 5), "debounced")
    assert sorted((k, (t - T0).seconds) for k, t in got) == [("j", 1), ("k", 0), ("k", 6), ("k", 12)]


def test_quiet_period_with_cap(spark, tmp_path):
    batches = [[("k", at(s)) for s in (0, 1, 2, 10)], [("c", at(20 + s)) for s in range(0, 40)], [("z", at(500))], [("z", at(501))]]
    got = run(spark, tmp_path, batches, "key string, at timestamp", lambda s: T.quiet_period(s.withWatermark("at", "1 second"), "key", "at", 2, 30), "quiet")
    shaped = sorted((k, (f - T0).seconds, (x - T0).seconds, n) for k, f, x, n in got)
    assert ("k", 0, 2, 3) in shaped and ("c", 20, 49, 30) in shaped and ("k", 10, 10, 1) in shaped


def test_stable_changes(spark, tmp_path):
    batches = [[("a", at(0), "h1"), ("b", at(0), "h1")], [("a", at(2), "h2"), ("b", at(3), None)], [("z", at(100), "x")], [("z", at(101), "x")]]
    got = run(spark, tmp_path, batches, "key string, at timestamp, print string", lambda s: T.stable_changes(s.withWatermark("at", "1 second"), "key", "at", "print", 5), "stable")
    assert sorted(got, key=str) == sorted([("b", None, "deleted"), ("a", "h2", "changed")], key=str)


def test_inbox_and_windows(spark, tmp_path):
    batches = [[("m1", at(0)), ("m1", at(1))], [("m1", at(2)), ("m2", at(2))]]
    got = run(spark, tmp_path, batches, "id string, at timestamp", lambda s: T.inbox(s, ["id"], "at", "1 hour"), "inbox")
    assert sorted(g[0] for g in got) == ["m1", "m2"]
    batches = [[("m", at(0)), ("m", at(59))], [("m", at(4000))], [("m", at(4001))]]
    got = run(spark, tmp_path, batches, "id string, at timestamp", lambda s: T.activity(s, "at", ["id"], "1 minute", "10 seconds"), "windows")
    assert ("m", 2) in [(g[1], g[2]) for g in got]


def test_relay_and_routes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, False), (2, 1, True), (3, 4, True)], "id int, attempts int, failed boolean")
    assert {r["id"]: r["route"] for r in T.route(rows, "attempts", "failed", 5).collect()} == {1: "ok", 2: "retry", 3: "dead_letter"}
    spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, body string").write.parquet(str(tmp_path / "outbox"))
    sent = []
    stream = spark.readStream.schema("id int, body string").parquet(str(tmp_path / "outbox"))
    for _ in range(2):
        T.relay(stream, lambda batch, number: sent.extend((number, r["id"]) for r in batch.collect()), str(tmp_path / "relay")).start().awaitTermination(60)
    assert sorted(sent) == [(0, 1), (0, 2)]
