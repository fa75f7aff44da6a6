"""Rolling sums, distinct counts, positions and quantiles against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventwarden.constants import DAY_US, HOUR_US, MINUTE_US
from eventwarden.operators.ordered import (
    SlicePolicy, exact_quantiles, last_rows, spread_of, with_position, with_slices,
)
from eventwarden.operators.rolling import (
    IP_PLAN, USER_PLAN, first_sightings, presence_edges, rolling, with_rolling,
)

CUT = SlicePolicy(min_rows=10, target_rows=7, max_hot_keys=1000)
SCHEMA = ("event_id bigint, user string, source_ip string, namespace string, object_type string, "
          "us bigint, is_failed int, is_sensitive int")


def _rows():
    """One user with a third of all rows, ties, and exact window edges."""
    rng = random.Random(5)
    start, rows = 19_700 * DAY_US, []
    for i in range(420):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(12)}"
        us = start + rng.randrange(40) * DAY_US + rng.randrange(24) * HOUR_US
        us += rng.choice([0, 0, 1, MINUTE_US, 5 * MINUTE_US])
        rows.append((i, user, f"ip{rng.randrange(4)}", rng.choice(["a", "b", None]),
                     f"o{rng.randrange(5)}", us, rng.randrange(2), rng.randrange(2)))
    edge = start + 100 * DAY_US
    for width in (DAY_US, 7 * DAY_US, 30 * DAY_US, 5 * MINUTE_US):
        for off in (-1, 0, 1):
            rows.append((len(rows), "edge", "ip9", "n", "o", edge - width + off, 1, 1))
    rows.append((len(rows), "edge", "ip9", "n", "o", edge, 0, 0))
    return rows


def _brute(rows, plan):
    names = ["event_id", "user", "source_ip", "namespace", "object_type", "us", "is_failed", "is_sensitive"]
    data = [dict(zip(names, r)) for r in rows]
    out = {}
    for e in data:
        def past(width):
            return [h for h in data if h[plan.key] == e[plan.key] and e["us"] - width <= h["us"] < e["us"]]
        found = [sum(h[s.value] if s.value else 1 for h in past(s.width_us)) for s in plan.sums]
        found += [len({h[d.column] for h in past(d.width_us)} - {None}) for d in plan.distincts]
        hour = e["us"] // HOUR_US % 24
        found += [sum(h["us"] // HOUR_US % 24 == hour for h in past(x.width_us)) for x in plan.hours]
        out[(e[plan.key], e["us"])] = tuple(found)
    return out


@pytest.mark.parametrize("policy", [SlicePolicy(), CUT], ids=["whole", "cut"])
@pytest.mark.parametrize("plan", [USER_PLAN, IP_PLAN], ids=["user", "ip"])
def test_rolling_equals_brute_force(spark, plan, policy):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    want = _brute(rows, plan)
    names = [s.name for s in (*plan.sums, *plan.distincts, *plan.hours)]
    found = with_rolling(df, plan, policy=policy).select("event_id", plan.key, "us", *names).collect()
    assert len(found) == len(rows)
    assert all(tuple(r[3:]) == want[(r[1], r[2])] for r in found)
    changes = {(r[0], r[1]): tuple(r[2:]) for r in rolling(df, plan, policy=policy).collect()}
    assert changes == want


def test_hot_key_is_cut_and_not_collected(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    plan = with_rolling(df, USER_PLAN, policy=CUT)._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan
    assert "collect_" not in plan
    # Whole keys: one shuffle, no join.
    whole = with_rolling(df, USER_PLAN)._jdf.queryExecution().executedPlan().toString()
    assert "_slice" not in whole and "Join" not in whole
    assert whole.count("Exchange hashpartitioning") == 1


def test_slices_of_a_burst_hold_equally_many_rows(spark):
    """A third of all rows on one key, nearly all of them within one hour; another key far apart in time."""
    rng = random.Random(4)
    start = 19_700 * DAY_US
    rows = [("hot", start + (rng.randrange(HOUR_US) if n % 50 else rng.randrange(40 * DAY_US))) for n in range(4000)]
    rows += [("wide", start + rng.choice([0, 10 ** 17]) + rng.randrange(DAY_US)) for _ in range(2000)]
    rows += [(f"k{n % 600}", start + rng.randrange(40 * DAY_US)) for n in range(6000)]
    df = spark.createDataFrame(rows, "user string, us bigint")
    policy = SlicePolicy(min_rows=500, target_rows=100)
    spread = spread_of(df, ["user"], "us", policy)
    sizes = {}
    for r in with_slices(df, ["user"], "us", spread).groupBy("user", "_slice").count().collect():
        sizes.setdefault(r.user, {})[r["_slice"]] = r["count"]
    assert set(sizes["hot"]) == set(range(40)) and max(sizes["hot"].values()) <= 120
    assert set(sizes["wide"]) == set(range(20)) and max(sizes["wide"].values()) <= 120
    assert all(set(v) == {None} for k, v in sizes.items() if k.startswith("k"))
    # Slices follow the order.
    ends = with_slices(df, ["user"], "us", spread).where("user = 'hot'").groupBy("_slice").agg(
        F.min("us").alias("a"), F.max("us").alias("b")).orderBy("_slice").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))


def test_slices_are_even_over_what_is_taken_back(spark):
    """Rows of one hour are taken back in one later hour; that hour is cut too."""
    start = 19_700 * DAY_US
    df = spark.createDataFrame([("hot", start + 1000 * n) for n in range(2000)], "user string, us bigint")
    spread = spread_of(df, ["user"], "us", SlicePolicy(min_rows=500, target_rows=100), echoes=[DAY_US])
    later = df.withColumn("us", F.col("us") + DAY_US)
    assert with_slices(later, ["user"], "us", spread).select("_slice").distinct().count() >= 9


def test_first_sightings_and_edges(spark):
    us = [0, 10, HOUR_US, 5 * HOUR_US, 5 * HOUR_US + 1, 9 * HOUR_US + 1]
    df = spark.createDataFrame([("k", u) for u in us], "k string, us bigint")
    gap = 4 * HOUR_US
    assert {(r.us, r.previous_us) for r in first_sightings(df, ["k"], "us", gap).collect()} == {(0, None)}
    assert {(r.us, r.previous_us) for r in first_sightings(df, ["k"], "us", gap - 1).collect()} == {
        (0, None), (5 * HOUR_US, HOUR_US), (9 * HOUR_US + 1, 5 * HOUR_US + 1)}
    edges = {(r.us, r.edge) for r in presence_edges(df, ["k"], "us", F.lit(gap)).collect()}
    assert edges == {(0, 1), (13 * HOUR_US + 1, -1)}


@pytest.mark.parametrize("keys", [[], ["user"]])
def test_positions(spark, keys):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.event_id: r.p for r in with_position(df, keys, "us", "event_id", "p", CUT).collect()}
    order = sorted(rows, key=lambda r: (r[5], r[0]))
    seen: dict = {}
    for r in order:
        key = r[1] if keys else None
        assert found[r[0]] == seen.get(key, 0)
        seen[key] = seen.get(key, 0) + 1


def test_last_rows_across_blocks(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.event_id: list(r.w) for r in last_rows(
        df, ["user"], "us", "event_id", 5, "event_id", "w", block=7, policy=CUT).collect()}
    past: dict = {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        past.setdefault(r[1], []).append(r[0])
        assert found[r[0]] == past[r[1]][-5:]
    assert len(found) == len(rows)


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 1.0, 1.0], [0.5, -2.0, 7.25, 7.25, 9.0], list(np.random.RandomState(0).normal(size=501)),
])
def test_quantiles_equal_linear_interpolation(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    shares = [0.0, 0.25, 0.9, 0.95, 0.99, 1.0]
    found = {r.share: r.quantile for r in exact_quantiles(df, "v", shares, CUT).collect()}
    for s in shares:
        assert found[s] == pytest.approx(np.percentile(values, 100 * s), abs=1e-12)


@pytest.mark.parametrize("slots", [3, 100_000])
def test_nth_value_with_ties(spark, slots):
    from eventwarden.operators.ordered import is_before_row, nth_value

    rng = random.Random(9)
    rows = [(i, rng.choice([5, 7, 7, 900, -10 ** 12, 10 ** 15])) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, us bigint").persist()
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for n in (0, 99, 199):
        value, before = nth_value(df, "us", n, slots)
        assert value == ordered[n][1]
        assert before == sum(r[1] < value for r in rows)
    with pytest.raises(ValueError):
        nth_value(df, "us", 200)
    for n in (0, 1, 77, 200):
        first = {r.event_id for r in df.where(is_before_row(df, n, "us", "event_id")).collect()}
        assert first == {r[0] for r in ordered[:n]}
