"""Cuts along a whole frame hold about equally many rows, wherever the values lie."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventwarden.models.drift import auc
from eventwarden.operators.ordered import (
    SLICE, SlicePolicy, exact_quantiles, spread_of, with_global_slices, with_position,
)

CUT = SlicePolicy(min_rows=100, target_rows=50)


def test_one_far_value_does_not_fill_one_slice(spark):
    rows = spark.range(1000).select(F.when(F.col("id") == 7, 1e15).otherwise(F.col("id") / 1000).alias("v"))
    sliced = with_global_slices(rows, "v", spread_of(rows, [], "v", CUT), CUT)
    sizes = [r["count"] for r in sliced.groupBy(SLICE).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 18 and max(sizes) <= 60
    found = {r["share"]: r["quantile"] for r in exact_quantiles(rows, "v", (0.0, 0.5, 1.0), CUT).collect()}
    assert found[0.0] == 0.0 and found[1.0] == 1e15 and abs(found[0.5] - 0.5005) < 1e-9


def test_auc_with_a_far_value(spark):
    rows = spark.createDataFrame([(1e15, 1), (0.1, 0), (0.2, 1), (0.2, 0), (0.3, 0), (None, 1), (0.4, None)], "s double, t int")
    assert auc(rows, "s", "t", CUT).first()["auc"] == (3 + 1.5) / 6


def test_a_crowded_instant_is_cut_along_the_tie(spark):
    rows = spark.range(3000).select(
        F.col("id"), (F.col("id") % 2).alias("key"), F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("us"))
    for keys in ([], ["key"]):
        want = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("us", "id")) - 1)
        found = with_position(rows, keys, "us", "id", "place", CUT)
        assert found.count() == 3000
        columns = ["id", "place"]
        assert want.select(columns).exceptAll(found.select(*[F.col(c).cast("int" if c == "place" else "bigint") for c in columns])).count() == 0


def test_an_empty_frame_has_no_slices(spark):
    rows = spark.range(0).select(F.col("id"), F.col("id").alias("us"))
    assert with_position(rows, [], "us", "id", "place", CUT).count() == 0
    assert exact_quantiles(rows, "us", (0.5,), CUT).count() == 0
