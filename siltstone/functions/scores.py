"""Scores and ladders of conditions, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def freshness(age_days: Column, half_life: float) -> Column:
    """exp(-age/half-life), 1 for what lies in the future, null without an age."""
    return F.when(age_days.isNotNull(), F.exp(-F.greatest(age_days, F.lit(0.0)) / half_life))


def lifecycle_score(confidence: Column, age_days: Column, confirmation_age: Column, reinforcement: Column, usage: Column, penalty: Column) -> Column:
    """0.40 confidence + 0.20 recency + 0.20 confirmation + 0.15 reinforcement + 0.05 usage, times the penalties, within 0 and 1."""
    confirmed = F.coalesce(freshness(confirmation_age, 90.0), F.lit(0.35))
    used = F.least(F.log1p(F.greatest(usage, F.lit(0)).cast("double")) / math.log1p(20), F.lit(1.0))
    base = clamp(confidence) * 0.40 + freshness(age_days, 120.0) * 0.20 + confirmed * 0.20 + reinforcement * 0.15 + used * 0.05
    return clamp(base * penalty)


def backoff(base: Column | float, attempt: Column, most: float) -> Column:
    base = F.lit(float(base)) if not isinstance(base, Column) else base
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(16))))


def confidence_band(streams: Column, exact: Column, rank: Column) -> Column:
    """insufficient, high, medium or low from the agreement of streams, an exact signal and the rank."""
    return F.when(streams == 0, "insufficient").when((streams >= 2) & (exact | (rank <= 3)), "high").when((streams >= 2) | exact, "medium").otherwise("low")


def status_group(status: Column) -> Column:
    s = F.lower(status)
    return (
        F.when(s.startswith("blocked"), "blocked").when(s.isin("failed", "error", "dead_letter"), "failed").when(s.isin("running", "busy", "claimed"), "running")
        .when(s.isin("pending", "queued") | s.startswith("retrying"), "pending").otherwise("completed")
    )


def first_failing(*tests: tuple[Column, str]) -> Column:
    """The reason of the first test that fails, null if all hold."""
    ladder = None
    for test, reason in tests:
        fails = ~F.coalesce(test, F.lit(False))
        ladder = F.when(fails, reason) if ladder is None else ladder.when(fails, reason)
    return ladder


def range_label(value: Column, bounds: list[int]) -> Column:
    """The half-open range that holds a value, as text."""
    label, low = None, 0
    for high in bounds:
        test = value < high
        text = f"{low}-{high - 1}"
        label = F.when(test, text) if label is None else label.when(test, text)
        low = high
    return F.when(value.isNull(), "unknown").otherwise(label.otherwise(f"{low}+"))


def deprioritised(current: Column, state: Column, retention: Column, factors: dict[str, Column]) -> Column:
    """The reasons, in this order, for which a result stands lower; an empty array where there are none."""
    good = state.isin("", "active", "confirmed", "reinforced")
    reasons = [F.when(~current, "non_current"), F.when(~good, F.concat(F.lit("state:"), state)), F.when(retention != "keep", F.concat(F.lit("retention:"), retention))]
    return F.array_compact(F.array(*reasons, *[F.when(value < 1.0, f"penalty:{name}") for name, value in factors.items()]))
