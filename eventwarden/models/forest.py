"""Isolation forest: grown per tree from small samples, applied to all rows.

Training never moves the data set. Rows get a random rank from a hash; the lowest
``trees * sample`` ranks form a pool of bounded size, and each tree takes its rows
from the pool by an affine walk over the ranks, which never repeats a row within a
tree. Each tree grows in its own task from at most ``sample`` rows.

Trees have a fixed depth, so a forest is three dense arrays of known size: that is
what scoring broadcasts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventwarden import constants as K

FOREST_SCHEMA = "tree int, taken int, features array<int>, thresholds array<double>, paths array<double>"


@dataclass(frozen=True)
class Forest:
    """Inner nodes in breadth-first order and the path length of each last place."""
    features: np.ndarray        # (trees, 2**depth - 1)
    thresholds: np.ndarray      # (trees, 2**depth - 1)
    paths: np.ndarray           # (trees, 2**depth)
    sample: int

    @property
    def depth(self) -> int:
        return int(math.log2(self.paths.shape[1]))


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(values: np.ndarray, depth: int, rng: np.random.RandomState):
    """Split breadth-first; a place that cannot be split sends all rows left."""
    inner = 2 ** depth - 1
    features = np.zeros(inner, dtype=np.int32)
    thresholds = np.full(inner, np.inf)
    # Rows at each place, and the depth at which the place stopped splitting.
    rows: dict[int, np.ndarray] = {0: np.arange(len(values))}
    ended: dict[int, float] = {}
    for place in range(inner):
        held = rows.pop(place, np.empty(0, dtype=int))
        left, right = 2 * place + 1, 2 * place + 2
        if place in ended:
            ended[left] = ended[place]
            continue
        if len(held) == 0:
            continue
        low, high = values[held].min(axis=0), values[held].max(axis=0)
        usable = np.flatnonzero(high > low)
        if len(held) <= 1 or len(usable) == 0:
            ended[left] = math.floor(math.log2(place + 1)) + expected_path(len(held))
            continue
        feature = int(rng.choice(usable))
        cut = rng.uniform(low[feature], high[feature])
        goes_right = values[held, feature] > cut
        features[place], thresholds[place] = feature, cut
        rows[left], rows[right] = held[~goes_right], held[goes_right]
    paths = np.zeros(2 ** depth)
    for spot in range(2 ** depth):
        place = inner + spot
        held = rows.get(place)
        paths[spot] = ended[place] if place in ended else depth + expected_path(
            0 if held is None else len(held))
    return features, thresholds, paths


def sample_pool(matrix: DataFrame, key: str, columns: Sequence[str], size: int, rows: int,
                seed: int) -> DataFrame:
    """``size`` rows chosen uniformly, with their random rank from 0."""
    marked = matrix.select(*columns, F.xxhash64(F.lit(seed), F.col(key)).alias("_draw"))
    if rows > 4 * size:
        # Keep a margin over the wanted share, then cut to the exact size.
        share = size / rows
        share += 8 * math.sqrt(share / rows)
        top = int((2 * share - 1) * (2 ** 63 - 1)) if share < 1 else 2 ** 63 - 1
        likely = marked.where(F.col("_draw") <= F.lit(top))
        # Repeated keys draw alike and can leave the share too small; then all rows are ranked.
        marked = likely if likely.limit(size).count() == size else marked
    pool = marked.orderBy("_draw", *columns).limit(size)
    # At most ``size`` rows, a setting of the model, are ranked together.
    return pool.withColumn("_rank", F.row_number().over(Window.orderBy("_draw", *columns)) - 1)


def _walks(trees: int, pool: int, seed: int) -> list[tuple[int, int, int]]:
    """Per tree a stride coprime to the pool size, and a start."""
    rng = np.random.RandomState(seed)
    walks = []
    for tree in range(trees):
        stride = int(rng.randint(1, max(pool, 2)))
        while math.gcd(stride, pool) != 1:
            stride = stride % pool + 1
        walks.append((tree, stride, int(rng.randint(0, pool))))
    return walks


def fit_forest(matrix: DataFrame, key: str = "event_id", columns: Sequence[str] = K.FEATURE_COLS,
               trees: int = K.FOREST_TREES, sample: int = K.FOREST_SAMPLE, seed: int = 42,
               rows: int | None = None) -> DataFrame:
    """The forest as a table with one row per tree."""
    columns = list(columns)
    rows = matrix.count() if rows is None else rows
    if rows < K.MIN_TRAIN_ROWS:
        raise ValueError(f"{rows} rows are too few to train, {K.MIN_TRAIN_ROWS} are needed")
    size = min(rows, trees * sample)
    taken = min(sample, size)
    depth = max(math.ceil(math.log2(taken)), 1)
    spark = matrix.sparkSession
    pool = sample_pool(matrix, key, columns, size, rows, seed)
    walks = spark.createDataFrame(_walks(trees, size, seed), "tree int, stride bigint, start bigint")
    picks = walks.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(taken - 1)))).select(
        "tree", F.pmod(F.col("stride") * F.col("_step") + F.col("start"),
                       F.lit(size).cast("bigint")).cast("int").alias("_rank"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        values = pdf.sort_values("_rank")[columns].to_numpy(dtype=float)
        features, thresholds, paths = _grow(values, depth, np.random.RandomState(seed + tree))
        return pd.DataFrame({"tree": [tree], "taken": [taken], "features": [features.tolist()],
                             "thresholds": [thresholds.tolist()], "paths": [paths.tolist()]})

    # A fixed number of partitions: the rows are few but growing trees takes time.
    tasks = min(trees, 2 * spark.sparkContext.defaultParallelism)
    drawn = picks.join(pool.drop("_draw"), "_rank").repartition(tasks, "tree")
    return drawn.groupBy("tree").applyInPandas(grow, FOREST_SCHEMA)


def load_forest(table: DataFrame) -> Forest:
    """Bring the model to the driver; its size is set by trees and depth alone."""
    # Sorted here: a distributed sort would first grow all trees once to see how they spread.
    rows = table.toPandas().sort_values("tree", ignore_index=True)
    return Forest(
        np.array(rows["features"].tolist(), dtype=np.int32),
        np.array(rows["thresholds"].tolist(), dtype=float),
        np.array(rows["paths"].tolist(), dtype=float), int(rows["taken"].max()))


def raw_score(spark: SparkSession, forest: Forest, columns: Sequence[str] = K.FEATURE_COLS) -> Column:
    """Larger means more normal, between -1 and 0."""
    # Plain arrays, which a worker reads without this package.
    shared = spark.sparkContext.broadcast((forest.features, forest.thresholds, forest.paths))
    scale, depth = expected_path(forest.sample), forest.depth

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        features, thresholds, paths = shared.value
        inner = features.shape[1]
        for batch in batches:
            values = np.vstack([s.to_numpy(dtype=float) for s in batch])
            total = np.zeros(values.shape[1])
            # A tree at a time over plain arrays that stay in cache; in a chunk, a feature's values lie one after another.
            for start in range(0, len(total), 8192):
                part = np.ascontiguousarray(values[:, start:start + 8192])
                flat, line = part.reshape(-1), np.arange(part.shape[1])
                begins = features.astype(np.int64) * len(line)
                found = np.empty((len(features), len(line)))
                for tree in range(len(features)):
                    begin, threshold = begins[tree], thresholds[tree]
                    place = (part[features[tree, 0]] > threshold[0]) + np.int64(1)
                    for _ in range(depth - 1):
                        spot = begin.take(place)
                        spot += line
                        right = flat.take(spot) > threshold.take(place)
                        place += place
                        place += 1
                        place += right
                    place -= inner
                    found[tree] = paths[tree].take(place)
                total[start:start + 8192] = np.ascontiguousarray(found.T).mean(axis=1)
            yield pd.Series(-np.exp2(-total / scale))

    return score(*[F.col(c).cast("double") for c in columns])


def score_stats(scored: DataFrame, raw: str = "raw_score") -> DataFrame:
    """One row: range, mean, population deviation and the upper quantiles."""
    from eventwarden.operators.ordered import exact_quantiles

    base = scored.agg(
        F.count(raw).alias("n"), F.min(raw).alias("min"), F.max(raw).alias("max"),
        F.avg(raw).alias("mean"), F.stddev_pop(raw).alias("std"))
    tails = exact_quantiles(scored, raw, (0.9, 0.95, 0.99)).agg(*[
        F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(name)
        for s, name in ((0.9, "p90"), (0.95, "p95"), (0.99, "p99"))])
    one = F.lit(1).alias("_one")
    return base.select("*", one).join(tails.select("*", one), "_one").drop("_one")


def normalized(raw: Column, low: float, high: float) -> Column:
    """1 at the most unusual training score, 0 at the most usual; not clipped.

    A constant shift of the raw score, such as a contamination offset, cancels here.
    """
    if high == low:
        return F.lit(0.5)
    return F.lit(1.0) - (raw - F.lit(low)) / F.lit(high - low)
