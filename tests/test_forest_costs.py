"""Costs of scoring whole tables: trees grown twice, frames in few tasks, digests worked out for every row."""

import time

import numpy as np
from pyspark.sql import functions as F

from eventwarden.functions.hashing import hash_bucket, hash_bucket_once
from eventwarden.models.forest import FOREST_SCHEMA, load_forest
from eventwarden.operators import rolling
from eventwarden.plans.features import HISTORY_INPUT, feature_columns, rolling_features


def test_every_tree_is_grown_once(spark):
    grown = spark.sparkContext.accumulator(0)

    def grow(batches):
        for part in batches:
            grown.add(len(part))
            part["taken"] = 256
            for name, size in (("features", 3), ("thresholds", 3), ("paths", 4)):
                part[name] = [np.full(size, tree).tolist() for tree in part["tree"]]
            yield part

    table = spark.range(0, 40, 1, 4).select((39 - F.col("id")).cast("int").alias("tree")).mapInPandas(grow, FOREST_SCHEMA)
    forest = load_forest(table)
    assert grown.value == 40
    assert forest.features[:, 0].tolist() == list(range(40)) and forest.paths.shape == (40, 4) and forest.sample == 256


def _events(spark, rows, users):
    return spark.range(0, rows, 1, 4).select(
        F.col("id").alias("event_id"), F.concat(F.lit("user-"), F.col("id") % users).alias("user"),
        F.concat(F.lit("10.0.0."), F.col("id") % 40).alias("source_ip"), F.lit("prod").alias("namespace"),
        F.concat(F.lit("pods/"), F.col("id") % 12).alias("object_type"), (F.col("id") * 1_000_000_007).alias("us"),
        (F.col("id") % 7 == 0).cast("int").alias("is_failed"), (F.col("id") % 3 == 0).cast("int").alias("is_sensitive"))


def test_more_rows_mean_more_tasks_of_frames(spark, monkeypatch):
    monkeypatch.setattr(rolling, "FRAME_ROWS", 50, raising=False)
    events = _events(spark, 2000, 400)
    found = rolling.with_rolling(events, rolling.USER_PLAN, events.select(*HISTORY_INPUT))
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 250


def test_repeated_values_are_hashed_once_a_batch(spark):
    odd = _events(spark, 200, 20).withColumns({
        "user": F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "Zoë 😀").otherwise(F.col("user")),
        "namespace": F.when(F.col("event_id") % 3 > 0, "prod"),
        "object_type": F.when(F.col("event_id") % 2 == 0, F.expr("cast(x'c328ff' as string)")).otherwise("pods"),
        "method": F.lit("get"), "event_type": F.lit("app")})
    flags = ("hour", "day_of_week", "is_off_hours", "is_high_risk", "is_rbac")
    whole = feature_columns(rolling_features(odd.withColumns({c: F.lit(0) for c in flags})), hash_bucket_once)
    for name, column, buckets in (("user", "user", 10_000), ("namespace", "namespace", 5_000)):
        assert whole.where(~F.col(f"feat_{name}_hash").eqNullSafe(hash_bucket(F.col(column), buckets).cast("double"))).count() == 0
    plain = hash_bucket(F.col("object_type"), 5_000).cast("double")
    kinds = whole.select("object_type", "feat_object_type_hash").distinct()
    assert kinds.count() == 2 and plain is not None

    wide = spark.range(0, 1_200_000, 1, 8).select(*[
        F.concat(F.lit(name + "-"), (F.col("id") % 500).cast("string")).alias(name)
        for name in ("user", "source_ip", "namespace", "object_type", "method", "event_type")])
    others = [c for c in rolling_features(odd.withColumns({c: F.lit(0) for c in flags})).columns if c not in wide.columns]
    wide = wide.select("*", *[F.lit(0).alias(c) for c in others])
    hashes = [f"feat_{c}_hash" for c in ("user", "ip", "namespace", "object_type", "method", "event_type")]

    def seconds(df):
        begin = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - begin

    rows = feature_columns(wide, hash_bucket_once).select(*hashes)
    each = wide.select(*[hash_bucket(F.col(c), 10_000) for c in wide.columns[:6]])
    seconds(rows), seconds(each)
    assert seconds(rows) < 0.8 * seconds(each)
