"""Labelled rows for small models: folds by id, and bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows per class a model is fitted on at most. The rows with the smallest id hashes are taken.
PER_CLASS = 4000


def fold(id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id.cast("string").cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, id: str = "doc_id",
             text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """(id, text, label) of at most ``per_class`` rows per class outside the held-out fold.

    Null ids, null labels and labels other than 0 and 1 are not used. An id with several labels counts as 1 if one of
    them is; of several texts of an id the one with the smallest hash is taken.
    """
    known = labels.where(F.col(label).isin(0, 1) & (fold(F.col(id), folds) != held_out)).groupBy(
        F.col(id).cast("bigint").alias("id")).agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("id")
    some = known.where("label = 0").orderBy(order, "id").limit(per_class).unionByName(
        known.where("label = 1").orderBy(order, "id").limit(per_class))
    # At most two rows per unit of per_class: small enough to send to every task.
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    return rows.join(F.broadcast(some), "id").groupBy("id", "label").agg(first.alias("first")).select("id", "first.text", "label")


def class_counts(labels: DataFrame, label: str, folds: int, held_out: int, id: str = "doc_id") -> tuple[int, int]:
    """Rows of class 0 and 1 outside the held-out fold."""
    row = labels.where(fold(F.col(id), folds) != held_out).agg(
        F.count(F.when(F.col(label) == 0, 1)), F.count(F.when(F.col(label) == 1, 1))).first()
    return int(row[0]), int(row[1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; a column of ones must be part of ``x``."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def balanced(y: np.ndarray, zeros: int, ones: int) -> np.ndarray:
    """Row weights that give a sample the class shares of the whole."""
    counts = np.bincount(y.astype(int), minlength=2)
    share = np.array([zeros, ones], dtype=float) / max(1, zeros + ones)
    return (share / np.maximum(counts, 1))[y.astype(int)] * len(y)
