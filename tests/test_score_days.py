import math

import pytest
from pyspark.sql import functions as F

from eventwarden.adapter import scorer_events
from eventwarden.models.drift import psi
from eventwarden.models.score_days import drift_between, drift_by_day, merged, quantile, score_days


@pytest.fixture(scope="module")
def scores(spark, small):
    return scorer_events(spark, small).select("event_id", "ts", "anomaly_score")


def test_days_of_batches_merge_into_the_days_of_all(spark, scores):
    parts = [score_days(scores.where(F.col("event_id") % 3 == i)) for i in range(3)]
    together = merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), "day").drop("sketch")
    whole = score_days(scores).drop("sketch")
    assert whole.count() > 5
    assert sorted(together.collect()) == sorted(whole.collect())


def test_drift_from_days_equals_drift_of_all_scores(spark, scores):
    middle = F.to_date(F.lit("2024-01-15"))
    days = score_days(scores)
    found = drift_between(days.where(F.col("day") < middle), days.where(F.col("day") >= middle)).first()
    early = F.to_date("ts") < middle
    want = psi(scores.select(F.when(early, F.col("anomaly_score")).alias("old"),
                             F.when(~early, F.col("anomaly_score")).alias("new")), "old", "new").first()
    assert (found["n_old"], found["n_new"]) == (want["n_old"], want["n_new"])
    assert math.isclose(found["psi"], want["psi"], rel_tol=1e-12)


def test_percentiles_of_merged_sketches_keep_their_rank(spark):
    rows = spark.range(200_000).select(
        F.col("id"), F.timestamp_seconds(F.col("id") * 20).alias("ts"),
        ((F.col("id") * 7919) % 200_000 / 200_000.0).alias("anomaly_score"))
    one = merged(score_days(rows)).select(*[quantile(s).alias(f"q{i}") for i, s in enumerate((0.5, 0.9, 0.95, 0.99))]).first()
    for found, share in zip(one, (0.5, 0.9, 0.95, 0.99)):
        assert abs(found - share) < 0.01


def test_odd_scores(spark):
    rows = spark.createDataFrame([(None, None), (None, 0.5), ("2024-01-01 00:00:00", 7.0), ("2024-01-01 00:00:00", None)],
                                 "ts string, anomaly_score double").withColumn("ts", F.col("ts").cast("timestamp"))
    days = {r["day"]: r for r in score_days(rows).drop("sketch").collect()}
    assert len(days) == 2 and sum(days[None]["bins"]) == 1
    # A score outside the bins counts in the total only.
    known = [r for d, r in days.items() if d is not None][0]
    assert (known["n"], known["n_high"], sum(known["bins"])) == (1, 1, 0)
    assert drift_by_day(score_days(rows.where("false"))).count() == 0
