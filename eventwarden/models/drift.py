"""Score drift, model replacement, and classifier quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.operators.ordered import (
    DEFAULT_POLICY, SlicePolicy, spread_of, sums_before, with_global_slices,
)


def score_bin(score: Column, bins: int) -> Column:
    """Bin of a score in [0, 1]; the last bin is closed, outside is null.

    The edges are the multiples i * (1 / bins) in double arithmetic.
    """
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    case = F
    for i in range(bins):
        below = score < edges[i + 1] if i < bins - 1 else score <= edges[i + 1]
        case = case.when((score >= edges[i]) & below, F.lit(i))
    return case


def psi(scores: DataFrame, expected: str, actual: str, bins: int = K.PSI_BINS) -> DataFrame:
    """One row with the population stability index of two score columns.

    Scores outside [0, 1] count in the totals only; an empty bin gets a floor.
    """
    tall = scores.select(F.inline(F.array(
        F.struct(F.lit(True).alias("old"), F.col(expected).alias("score")),
        F.struct(F.lit(False).alias("old"), F.col(actual).alias("score")),
    ))).where(F.col("score").isNotNull())
    # One pass: every bin count of both columns is a conditional count.
    spot = score_bin(F.col("score"), bins)
    counted = tall.agg(
        F.count_if(F.col("old")).alias("n_old"), F.count_if(~F.col("old")).alias("n_new"),
        *[F.count_if((spot == i) & F.col("old")).alias(f"o{i}") for i in range(bins)],
        *[F.count_if((spot == i) & ~F.col("old")).alias(f"a{i}") for i in range(bins)])

    index = psi_value([F.col(f"o{i}") for i in range(bins)], F.col("n_old"),
                      [F.col(f"a{i}") for i in range(bins)], F.col("n_new"))
    return counted.select("n_old", "n_new", index.alias("psi"))


def psi_value(old: Sequence[Column], n_old: Column, new: Sequence[Column], n_new: Column) -> Column:
    """The index from the counts of the bins; an empty bin gets a floor."""
    def share(part: Column, whole: Column) -> Column:
        return F.when(part == 0, F.lit(K.PSI_FLOOR)).otherwise(part / whole)

    total = F.lit(0.0)
    for before, after in zip(old, new, strict=True):
        e, a = share(before, n_old), share(after, n_new)
        total = total + (a - e) * F.ln(a / e)
    return total


def psi_band(value: Column) -> Column:
    return F.when(value > K.PSI_DRIFT, "drift").when(value >= K.PSI_WATCH, "watch").otherwise("none")


def anomaly_rate(score: Column, above: float = 0.5) -> Column:
    """Share of scores above a limit, as an aggregate."""
    return F.count_if(score > above) / F.count(score)


def replace_decision(scores: DataFrame, old: str, new: str, force: bool = False) -> DataFrame:
    """Compare an old and a new model on the same rows and decide.

    Strong drift replaces the model and says so; otherwise a rate far above the old
    one stops the replacement unless it is forced.
    """
    rates = scores.agg(anomaly_rate(F.col(old)).alias("old_rate"), anomaly_rate(F.col(new)).alias("new_rate"))
    one = F.lit(1).alias("_one")
    both = psi(scores, old, new).select("*", one).join(rates.select("*", one), "_one").drop("_one")
    drift = F.col("psi") > K.PSI_DRIFT
    blown = F.col("new_rate") > F.col("old_rate") * K.RATE_BLOWUP
    outcome = (
        F.when(F.lit(force), "replaced").when(drift, "replaced with drift")
        .when(blown, "aborted").otherwise("replaced"))
    return both.select("old_rate", "new_rate", "psi", drift.alias("psi_alert"), outcome.alias("decision"))


def auc(scores: DataFrame, score: str, target: str, policy: SlicePolicy = DEFAULT_POLICY) -> DataFrame:
    """Exact area under the ROC curve; equal scores count one half.

    Scores are counted per value first; the negatives below each value come from
    sums over slices, so no task sorts all scores.
    """
    counts = scores.where(F.col(score).isNotNull() & F.col(target).isNotNull()).groupBy(
        F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(target) == 1).alias("_pos"), F.count_if(F.col(target) == 0).alias("_neg"))
    spread = spread_of(counts, [], "_score", policy)
    below = sums_before(with_global_slices(counts, "_score", spread, policy), [], "_score",
                        [([], {"_below": "_neg"})], True, distinct=True)
    # Twice the wins, so that ties stay whole numbers.
    parts = below.agg(
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"),
        F.sum(F.col("_pos") * (2 * F.col("_below") + F.col("_neg"))).alias("_wins"))
    return parts.select("positives", "negatives", F.try_divide(
        F.col("_wins").cast("double"),
        2.0 * F.col("positives").cast("double") * F.col("negatives").cast("double")).alias("auc"))


def binary_report(scores: DataFrame, score: str, target: str, cut: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of the positive class at a cut."""
    said, true = F.col(score) >= cut, F.col(target) == 1
    found = scores.agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    tp = F.col("tp")
    return found.select(
        "tp", "fp", "fn", "tn",
        F.coalesce(F.try_divide(tp, tp + F.col("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + F.col("fn")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))
