"""Scores summed up by day, so that drift and percentiles never read all scores again.

A day is one small row: counts, the bins of the stability index, and a quantile sketch. Rows of one day from several
batches merge into one. The index from merged bins equals the index over all scores; percentiles have a rank
error below one percent of the rows at the default sketch size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.models.drift import psi_value, score_bin

#: Items a sketch level holds; the rank error falls with it.
SKETCH_SIZE = 400


def score_days(scored: DataFrame, score: str = "anomaly_score", ts: str = "ts", high: float = 0.5,
               bins: int = K.PSI_BINS) -> DataFrame:
    """``(day, n, n_high, bins, sketch)`` of all scores that are not null. Rows without a time are the null day."""
    spot = score_bin(F.col(score), bins)
    return scored.where(F.col(score).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(
        F.count(score).alias("n"), F.count_if(F.col(score) > high).alias("n_high"),
        F.array(*[F.count_if(spot == i) for i in range(bins)]).alias("bins"),
        F.kll_sketch_agg_double(F.col(score).cast("double"), SKETCH_SIZE).alias("sketch"))


def merged(days: DataFrame, *keys: str, bins: int = K.PSI_BINS) -> DataFrame:
    """Summaries combined by ``keys``; without keys, one row for all."""
    return days.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_high").alias("n_high"),
        F.array(*[F.sum(F.col("bins")[i]) for i in range(bins)]).alias("bins"),
        F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"))


def quantile(share: float, sketch: str = "sketch") -> Column:
    """The score below which about ``share`` of a summary's rows lie."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def drift_by_day(days: DataFrame, bins: int = K.PSI_BINS) -> DataFrame:
    """``(day, n_before, n, rate, psi)``: every day but the first against all days before it."""
    # One row per day goes through this window, not one per score.
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    known = days.where("day IS NOT NULL").select(
        "day", "n", "n_high", "bins", F.sum("n").over(before).alias("n_before"),
        *[F.sum(F.col("bins")[i]).over(before).alias(f"_o{i}") for i in range(bins)])
    index = psi_value([F.col(f"_o{i}") for i in range(bins)], F.col("n_before"),
                      [F.col("bins")[i] for i in range(bins)], F.col("n"))
    return known.where("n_before IS NOT NULL").select(
        "day", "n_before", "n", (F.col("n_high") / F.col("n")).alias("rate"), index.alias("psi"))


def drift_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(n_old, n_new, psi)`` between two groups of summaries, as ``psi`` over their scores."""
    one = F.lit(1).alias("_one")
    a = merged(old).select(F.col("n").alias("n_old"), F.col("bins").alias("_old"), one)
    b = merged(new).select(F.col("n").alias("n_new"), F.col("bins").alias("_new"), one)
    index = psi_value(*_parts("_old", "n_old"), *_parts("_new", "n_new"))
    return a.join(b, "_one").select("n_old", "n_new", index.alias("psi"))


def _parts(column: str, total: str, bins: int = K.PSI_BINS) -> tuple[Sequence[Column], Column]:
    return [F.col(column)[i] for i in range(bins)], F.col(total)
