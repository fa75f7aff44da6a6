"""Train, score, select alerts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.functions.rules import is_critical_alert, risk_level
from eventwarden.models import registry
from eventwarden.models.drift import anomaly_rate, auc, replace_decision
from eventwarden.models.forest import (
    Forest, fit_forest, load_forest, normalized, raw_score, score_stats,
)
from eventwarden.models.sequence import (
    fit_sequence, held_out, label_join, recent_window, sequence_score, sequence_windows, time_split,
)
from eventwarden.plans.features import reason_text
from eventwarden.session import cut_lineage


@dataclass(frozen=True)
class ForestModel:
    forest: Forest
    low: float
    high: float
    version: str

    def score(self, spark: SparkSession) -> Column:
        return normalized(raw_score(spark, self.forest), self.low, self.high)


@dataclass(frozen=True)
class SequenceModel:
    classifier: object
    means: list[float]
    deviations: list[float]
    version: str


HIGH_RATE = 0.3


def train_forest(matrix: DataFrame, folder: str, trees: int = K.FOREST_TREES,
                 share: float = K.TRAIN_SHARE, seed: int = 42, force: bool = False,
                 compare: bool = False) -> dict:
    """Fit on the earliest rows, check on the rest, publish."""
    return _fit_and_publish(time_split(matrix, share), folder, trees, seed, force, compare)


def retrain_forest(matrix: DataFrame, folder: str, trees: int = K.FOREST_TREES, seed: int = 42,
                   force: bool = False) -> dict:
    """Fit on the last month of the data without its last days, which judge the model.

    The newest published forest is scored on the same held-out rows, and a model
    that looks wrong is not published.
    """
    window = recent_window(matrix)
    found = window.count()
    if found < K.MIN_RETRAIN_ROWS:
        return {"status": "skipped", "rows": found}
    return _fit_and_publish(held_out(window), folder, trees, seed, force, compare=True)


def _fit_and_publish(split: DataFrame, folder: str, trees: int, seed: int, force: bool,
                     compare: bool) -> dict:
    spark = split.sparkSession
    # Read several times from here on: written once, training rows apart.
    split = cut_lineage(split.select("event_id", *K.FEATURE_COLS, "is_train"), by="is_train")
    train, rest = split.where("is_train"), split.where("NOT is_train")
    n_train, n_val = train.count(), rest.count()
    if n_train < K.MIN_TRAIN_ROWS:
        return {"status": "skipped", "n_train": n_train, "n_val": n_val}
    version = registry.new_version()
    path = f"{folder}/forest/{version}"
    fit_forest(train, trees=trees, seed=seed, rows=n_train).coalesce(1).write.parquet(path)
    forest = load_forest(spark.read.parquet(path))
    # The scores feed the range and the quantiles: computed once.
    raw = cut_lineage(train.select(raw_score(spark, forest).alias("raw_score")))
    stats = score_stats(raw).first().asDict()
    model = ForestModel(forest, stats["min"], stats["max"], version)
    facts = dict(stats)
    decision = "replaced"
    old = current_forest(spark, folder) if compare else None
    if n_val:
        scored = cut_lineage(rest.select(
            model.score(spark).alias("new"), *([old.score(spark).alias("old")] if old else [])))
        facts["anomaly_rate"] = scored.agg(anomaly_rate(F.col("new")).alias("r")).first()["r"]
        facts["rate_is_high"] = facts["anomaly_rate"] > HIGH_RATE
        if old:
            found = replace_decision(scored, "old", "new", force).first()
            decision = found["decision"]
            facts.update(found.asDict())
    if decision != "aborted":
        registry.publish(spark, folder, "forest", version, n_train, n_val, facts, path)
    return {"status": decision, "version": version, "n_train": n_train, "n_val": n_val, **facts}


def current_forest(spark: SparkSession, folder: str) -> ForestModel | None:
    """The newest published forest; asked again for each batch, so updates take effect."""
    try:
        row = registry.latest(spark, folder, "forest")
    except Exception as error:  # no registry yet
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    if row is None:
        return None
    registry.check_features(row)
    facts = json.loads(row["facts"])
    return ForestModel(load_forest(spark.read.parquet(row["path"])), facts["min"], facts["max"], row["version"])


def train_sequence(matrix: DataFrame, labels: DataFrame, folder: str, kind: str = "network",
                   iterations: int = 50, hidden: int = 64, share: float = 0.8) -> dict:
    """Fit the sequence model on labelled events, earliest first, and publish it."""
    spark = matrix.sparkSession
    windows = label_join(sequence_windows(matrix), labels).withColumn(
        "target", (F.col("label") == "anomaly").cast("int")).select("event_id", "us", "window", "seq_active", "target")
    split = cut_lineage(time_split(cut_lineage(windows), share), by="is_train")
    train, rest = split.where("is_train"), split.where("NOT is_train")
    n_train, n_val = train.count(), rest.count()
    if n_train == 0:
        raise ValueError("no labelled windows")
    width = len(K.FEATURE_COLS)
    classifier, means, deviations = fit_sequence(train, width, hidden=hidden, iterations=iterations, kind=kind)
    version = registry.new_version()
    path = f"{folder}/sequence/{version}"
    classifier.write().save(path)
    facts = {"means": means, "deviations": deviations, "kind": kind, "val_auc": None}
    if n_val:
        scored = sequence_score(rest, classifier, means, deviations, only_full=False)
        facts["val_auc"] = auc(scored, "seq_score", "target").first()["auc"]
    registry.publish(spark, folder, "sequence", version, n_train, n_val, facts, path)
    return {"version": version, "n_train": n_train, "n_val": n_val, "val_auc": facts["val_auc"]}


def current_sequence(spark: SparkSession, folder: str) -> SequenceModel | None:
    try:
        row = registry.latest(spark, folder, "sequence")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    if row is None:
        return None
    registry.check_features(row)
    facts = json.loads(row["facts"])
    return SequenceModel(registry.load_classifier(row["path"], facts["kind"]),
                         facts["means"], facts["deviations"], row["version"])


def combined_score(forest: Column, sequence: Column, active: Column) -> Column:
    both = F.lit(K.FOREST_WEIGHT) * forest + F.lit(K.SEQUENCE_WEIGHT) * sequence
    return F.when(active & sequence.isNotNull(), both).otherwise(forest)


def score_events(matrix: DataFrame, forest: ForestModel, sequence: SequenceModel | None = None,
                 digits: int = 4) -> DataFrame:
    """Feature rows to scored events: scores, risk, reason, model version.

    Rows that bring their ``window`` and ``seq_active`` along are scored with it.
    """
    spark = matrix.sparkSession
    rows = matrix.withColumn("_if", forest.score(spark))
    if sequence is not None:
        rows = rows if "window" in rows.columns else sequence_windows(rows)
        rows = sequence_score(rows, sequence.classifier, sequence.means,
                              sequence.deviations).drop("window")
    else:
        rows = rows.drop("window").withColumns({"seq_score": F.lit(None).cast("double"), "seq_active": F.lit(False)})
    total = combined_score(F.col("_if"), F.col("seq_score"), F.col("seq_active"))
    rows = rows.withColumn("_total", total)
    return rows.withColumns({
        "anomaly_score": F.bround("_total", digits),
        "if_score": F.bround("_if", digits),
        "seq_score": F.bround("seq_score", digits),
        "risk_level": risk_level(F.col("_total")),
        "reason": reason_text(),
        "model_version": F.lit(forest.version),
    }).drop("_if", "_total")


def select_alerts(scored: DataFrame, min_score: float = K.ALERT_MIN_SCORE) -> DataFrame:
    """Scored events that call for attention, with their text records."""
    critical = is_critical_alert(*[F.col(c) for c in (
        "risk_level", "anomaly_score", "event_type", "method", "object_type", "reason")], min_score)
    score = F.col("anomaly_score").cast("string")
    record = F.concat_ws(
        "\n", F.lit("HIGH RISK ALERT"), F.concat(F.lit("Source: "), "event_type"),
        F.concat(F.lit("User: "), "user"), F.concat(F.lit("Resource: "), "object_type"),
        F.concat(F.lit("Action/Rule: "), "method"), F.concat(F.lit("Score: "), score),
        F.concat(F.lit("Reason: "), "reason"), F.lit("-------------------------"))
    chat = F.concat_ws(
        "\n", F.lit("*HIGH Risk Security Alert Detected*"),
        *[F.concat(F.lit(f"*{title}:* `"), F.coalesce(F.col(c).cast("string"), F.lit("None")), F.lit("`"))
          for title, c in (("Source", "event_type"), ("Risk Level", "risk_level"),
                           ("Anomaly Score", "anomaly_score"), ("User", "user"),
                           ("Source IP", "source_ip"), ("Namespace", "namespace"),
                           ("Resource", "object_type"), ("Action / Falco Rule", "method"),
                           ("Time", "ts"))],
        F.concat(F.lit("*Reason:* "), "reason"))
    return scored.where(critical).withColumns({"alert_record": record, "alert_text": chat})
