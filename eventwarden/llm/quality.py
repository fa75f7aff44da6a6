"""Quality scores by pairwise ranking (Bradley-Terry).

Every text becomes a row of features. All pairs of a good and a bad labelled text are preferences; the weights
maximise the likelihood that the good one wins, a logistic loss on feature differences. The score of
a text is its weighted features; a threshold on it is a quantile of the scores of all texts. A second, two
parameter curve turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.samples import balanced, class_counts, labelled, logistic, sigmoid
from eventwarden.llm.words import words_of

#: Good rows whose pairs with all bad rows are summed at once.
PAIRED_ROWS = 256
SIGNS = b"!|%$&#*?.,;:()[]{}<>/\\=+-_\"'"


class Ranking(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -8, 8) @ self.weights

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid(self.offset + self.slope * raw)


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text; an empty text has zeros."""
    signs = np.full(256, len(SIGNS), dtype=np.int64)
    signs[list(SIGNS)] = np.arange(len(SIGNS))
    kinds = np.zeros(256, dtype=np.int64)
    kinds[ord("A"):ord("Z") + 1] = 1
    kinds[ord("a"):ord("z") + 1] = 2
    kinds[ord("0"):ord("9") + 1] = 3
    kinds[128:] = 4
    kinds[10] = 5
    blocks = [np.zeros((0, 0))]
    for found in words_of(column):
        count = len(found.first) - 1
        out = []
        for row in range(count):
            a, b = found.first[row], found.first[row + 1]
            out.append(_one(found, a, b, signs, kinds))
        blocks.append(np.array(out))
    return np.concatenate([b for b in blocks if b.size]) if any(b.size for b in blocks) else np.zeros((0, WIDTH))


def _one(found, a: int, b: int, signs: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    n = b - a
    if n == 0:
        return np.zeros(WIDTH)
    data = found.data[found.starts[a]:found.ends[b - 1]]
    size = len(data)
    sign = np.bincount(signs[data], minlength=len(SIGNS) + 1)[:len(SIGNS)] / n
    kind = np.bincount(kinds[data], minlength=6) / size
    lengths = found.ends[a:b] - found.starts[a:b]
    hashes = found.hashes[a:b]
    names, counts = np.unique(hashes, return_counts=True)
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:]
    upper = kinds[found.data[found.starts[a:b]]] == 1
    shouted = upper & (kinds[found.data[np.minimum(found.starts[a:b] + 1, found.ends[a:b] - 1)]] == 1) & (lengths > 1)
    last = found.data[found.ends[a:b] - 1]
    lone = (lengths == 1) & (kinds[last] == 0)
    rest = [
        np.log1p(n), np.log1p(size / n), lengths.std(), upper.mean(), shouted.mean(), lone.mean(),
        (kinds[last] == 0).mean(), len(names) / n, np.log1p(n) * (1 - len(names) / n), counts.max() / n,
        (hashes[1:] == hashes[:-1]).mean() if n > 1 else 0.0,
        len(np.unique(pairs)) / len(pairs) if n > 1 else 1.0,
        counts[counts > 1].sum() / n, kind[5] * size / n, (lengths > 20).mean(), (lengths <= 2).mean(),
    ]
    # Shares and their roots: a little of a bad sign already tells much.
    shares = np.concatenate([sign, kind])
    return np.concatenate([shares, np.sqrt(shares), rest])


WIDTH = 2 * (len(SIGNS) + 6) + 16


def preferences(good: np.ndarray, bad: np.ndarray, weight: float, ridge: float, rounds: int = 50) -> np.ndarray:
    """Weights under which good rows win over bad ones, by Newton steps on the logistic loss of all pairs.

    With s the score difference of a pair, its loss has the slope -(1 - p(s)) and the curvature p(s)(1 - p(s));
    sums over pairs of feature differences need the sums over rows only, so no pair is listed.
    """
    width = good.shape[1]
    w = np.zeros(width)
    for _ in range(rounds):
        gradient, curve = ridge * w, ridge * np.eye(width)
        lost, bent = np.zeros(len(bad)), np.zeros(len(bad))
        behind = bad @ w
        for low in range(0, len(good), PAIRED_ROWS):
            own = good[low:low + PAIRED_ROWS]
            miss = sigmoid(behind[None, :] - (own @ w)[:, None])
            bend = np.maximum(miss * (1 - miss), 1e-9)
            gradient -= weight * (own.T @ miss.sum(axis=1))
            lost += miss.sum(axis=0)
            bent += bend.sum(axis=0)
            cross = own.T @ (bend @ bad)
            curve += weight * ((own * bend.sum(axis=1)[:, None]).T @ own - cross - cross.T)
        gradient += weight * (bad.T @ lost)
        curve += weight * ((bad * bent[:, None]).T @ bad)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, scratch, label: str = "quality", folds: int = 5, held_out: int = 0,
          id: str = "doc_id", text: str = "text", ridge: float = 1.0) -> Ranking | None:
    """Fit weights on at most PER_CLASS labelled rows of each class outside the held-out fold.

    Without rows of both classes there is nothing to prefer, and None is returned.
    """
    sample = labelled(docs, labels, label, folds, held_out, id, text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column("text"))
            flat = pa.array(found.ravel())
            starts = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * WIDTH)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(starts, flat)], ["id", "label", "features"])

    rows = sample.select("id", "text", "label").mapInArrow(
        task, "id bigint, label int, features array<double>").orderBy("id").toArrow()
    if not len(rows):
        return None
    y = rows.column("label").to_numpy().astype(float)
    x = rows.column("features").combine_chunks().flatten().to_numpy().reshape(len(rows), WIDTH)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    weights = preferences(z[good], z[bad], len(y) / (len(good) * len(bad)), ridge)
    zeros, ones = class_counts(labels, label, folds, held_out, id)
    raw = z @ weights
    offset, slope = logistic(np.stack([np.ones(len(y)), raw], axis=1), y, balanced(y, zeros, ones), ridge=0.05)
    return Ranking(mean, scale, weights, float(offset), float(slope))


def score(docs: DataFrame, ranking: Ranking | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, raw, score) of every row, its whole text read: the ranking score, and the probability of label 1.

    Null and empty texts have zero features. Without a ranking every raw score is 0 and every score 0.5.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                raw = ranking.raw(features(part.column("text"))) if ranking is not None else np.zeros(len(part))
                chance = ranking.probability(raw) if ranking is not None else np.full(len(part), 0.5)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(raw), pa.array(chance)], ["id", "raw", "score"])

    return rows.mapInArrow(task, f"id {kind}, raw double, score double").withColumnRenamed("id", id)


def best(scored: DataFrame, share: float, accuracy: int = 10_000) -> DataFrame:
    """``scored`` with ``kept``: raw score at or above the quantile that leaves about ``share`` of all rows.

    The quantile is over all rows, within 1 / ``accuracy`` of their ranks; rows that tie with it are kept.
    """
    limit = scored.agg(F.percentile_approx("raw", F.lit(1.0 - share), F.lit(accuracy))).first()[0]
    return scored.withColumn("kept", F.col("raw") >= F.lit(limit if limit is not None else 0.0))
