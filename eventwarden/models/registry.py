"""Where trained models live: a table of versions and a folder per model."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.ml.classification import (
    LogisticRegressionModel, MultilayerPerceptronClassificationModel,
)
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from eventwarden import constants as K

SCHEMA = (
    "kind string, version string, trained_at timestamp, n_train bigint, n_val bigint, "
    "feature_cols array<string>, facts string, path string"
)


def new_version() -> str:
    return datetime.now(timezone.utc).strftime("v%Y%m%d_%H%M%S_%f")


def publish(spark: SparkSession, folder: str, kind: str, version: str, n_train: int, n_val: int,
            facts: dict, path: str, columns: Sequence[str] = K.FEATURE_COLS) -> None:
    """Append a version. Readers see it once its file is in place, never half of it."""
    row = (kind, version, datetime.now(timezone.utc), n_train, n_val, list(columns),
           json.dumps(facts), path)
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/registry")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{folder}/registry")


def latest(spark: SparkSession, folder: str, kind: str) -> Row | None:
    return versions(spark, folder).where(F.col("kind") == kind).orderBy(F.col("version").desc()).first()


def check_features(row: Row, columns: Sequence[str] = K.FEATURE_COLS) -> None:
    if list(row["feature_cols"]) != list(columns):
        raise ValueError(f"model {row['version']} was trained on other features")


def report(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of each kind, with its facts."""
    from eventwarden.operators.dedup import last_version

    newest = last_version(versions(spark, folder), "kind", ["version"])
    return newest.select(
        "kind", "version", "trained_at", "n_train", "n_val", F.size("feature_cols").alias("feature_count"),
        F.get_json_object("facts", "$.val_auc").cast("double").alias("val_auc"),
        F.get_json_object("facts", "$.anomaly_rate").cast("double").alias("anomaly_rate"))


def load_classifier(path: str, kind: str):
    reader = MultilayerPerceptronClassificationModel if kind == "network" else LogisticRegressionModel
    return reader.load(path)
