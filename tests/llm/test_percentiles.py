import datetime as dt
import math
import random

from siltstone.llm import percentiles as P

SCHEMA = "id string, service string, activity_class string, started_at timestamp_ntz, duration_ms int, pct string"


def test_exact_and_mergeable(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        service = rng.choice(["Hot", " hot ", "HOT\t", "cold", None])
        rows.append((f"e{i}", service, rng.choice(["a", None]), dt.datetime(2024, 1, 1 + i % 5), rng.choice([None, 0, 7, rng.randint(1, 10**6)]), "clash"))
    rows += rows[:50] + [(None, "cold", "a", None, 5, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    once = P.activity_once(frame)
    whole = P.value_counts(once, P.KEYS)
    days = P.value_counts(once, [*P.KEYS, "day"])
    merged = P.merge_counts(days.where("day <= '2024-01-02'"), days.where("day > '2024-01-02' or day is null"), keys=P.KEYS)
    as_set = lambda f: {tuple(r) for r in f.collect()}
    found = P.percentiles_of_counts(whole, P.KEYS)
    assert as_set(found) == as_set(P.percentiles_of_counts(merged, P.KEYS))
    groups = {}
    for r in {(r[0] if r[0] else object(), r) for r in rows}:
        _, service, cls, _, value, _ = r[1]
        if value is not None:
            groups.setdefault((service.strip().lower() if service else None, cls), []).append(value)
    expected = set()
    for (service, cls), values in groups.items():
        values.sort()
        n = len(values)
        for pct in (50, 90, 99):
            low, part = divmod((n - 1) * pct, 100)
            a, b = values[low], values[min(low + 1, n - 1)]
            expected.add((service, cls, pct, n, values[max(0, math.ceil(n * pct / 100) - 1)], round(a + (b - a) * part / 100, 6)))
    assert {(*tuple(r)[:5], round(r[5], 6)) for r in found.collect()} == expected


def test_edges(spark):
    assert P.percentiles_of_counts(P.value_counts(P.activity_once(spark.createDataFrame([], SCHEMA)), P.KEYS), P.KEYS).count() == 0
    ties = spark.createDataFrame([(f"i{i}", "s", "a", None, 9, None) for i in range(70)], SCHEMA)
    found = P.percentiles_of_counts(P.value_counts(P.activity_once(ties), P.KEYS), P.KEYS, least_rows=60)
    assert sorted((r["pct"], r["nearest"], r["interpolated"]) for r in found.collect()) == [(50, 9, 9.0), (90, 9, 9.0), (99, 9, 9.0)]
