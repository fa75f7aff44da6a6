"""Costs that once grew with what does not matter: long texts, wide tables of places, large training tasks."""

import time

import numpy as np
from pyspark.sql import functions as F

from eventwarden.functions.text import slug
from eventwarden.models.forest import Forest, expected_path, raw_score


def _whole_slug(text, default, joiner, width=96):
    """The slug by joining the whole text."""
    joined = F.regexp_replace(F.trim(text), "[^a-zA-Z0-9]+", joiner)
    bare = F.lower(F.regexp_replace(joined, f"^{joiner}+|{joiner}+$", ""))
    cut = F.substring(bare, 1, width)
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit(default)).otherwise(cut)


def _seconds(work):
    begin = time.time()
    work()
    return time.time() - begin


def test_slug_of_the_beginning_is_that_of_the_whole(spark):
    texts = [None, "", "  ", "\n-", "-" * 5000 + "a" * 95 + "-" * 5000 + "b\n", "a" * 96 + "  ", "a" * 95 + " é\n😀 ",
             "a" * 96 + "-b", "a" * 97, "Ünï Code 😀 x", " a\u0085b\r\n", "a-" * 60, "Ab " * 47 + "c" * 3 + "!!"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for joiner in ("_", "-"):
        for width in (1, 5, 96):
            wrong = rows.where(~slug(F.col("t"), "none", joiner, width).eqNullSafe(_whole_slug(F.col("t"), "none", joiner, width)))
            assert wrong.collect() == []


def test_slug_costs_its_beginning_only(spark):
    rows = spark.range(0, 40, 1, 4).select(F.expr("repeat(concat('Word ', id, '; '), 60000)").alias("t"))

    def run(rule):
        rows.select(rule(F.col("t"), "none", "-")).write.format("noop").mode("overwrite").save()

    run(slug)
    assert _seconds(lambda: run(slug)) < 0.6 * _seconds(lambda: run(_whole_slug))


def _walk(forest, values):
    """Every row through every tree, by tables of (rows, trees)."""
    trees, depth = np.arange(len(forest.features)), forest.depth
    total = np.zeros(len(values))
    for start in range(0, len(values), 2048):
        part = values[start:start + 2048]
        line, place = np.arange(len(part))[:, None], np.zeros((len(part), len(trees)), dtype=np.int64)
        for _ in range(depth):
            place = 2 * place + 1 + (part[line, forest.features[trees, place]] > forest.thresholds[trees, place])
        total[start:start + 2048] = forest.paths[trees, place - forest.features.shape[1]].mean(axis=1)
    return -np.exp2(-total / expected_path(forest.sample))


def test_forest_walk_is_exact_and_cheaper(spark):
    rng = np.random.RandomState(5)
    forest = Forest(rng.randint(0, 4, (100, 255)).astype(np.int32), np.where(rng.rand(100, 255) < 0.1, np.inf, rng.rand(100, 255)),
                    rng.rand(100, 256) * 9, 256)
    odd = [(0, float("nan"), 0.1, 0.9, 0.5), (1, float("inf"), float("-inf"), 0.2, float("nan")), (2, None, 0.3, 0.4, 0.5)]
    few = spark.createDataFrame(odd, "i long, a double, b double, c double, d double")
    many = spark.range(3, 150_003, 1, 1).select(
        F.col("id").alias("i"), *[((F.col("id") * p % 1009) / 1009.0).alias(n) for n, p in zip("abcd", (7, 11, 13, 17))])
    rows = few.coalesce(1).unionByName(many).select("*", raw_score(spark, forest, tuple("abcd")).alias("s"))
    got = rows.toPandas().sort_values("i")
    values = got[list("abcd")].to_numpy(dtype=float)
    assert np.array_equal(got["s"].to_numpy(), _walk(forest, values))
    assert _seconds(lambda: rows.write.format("noop").mode("overwrite").save()) < _seconds(lambda: _walk(forest, values))


def test_training_tasks_hold_bounded_vectors(spark, monkeypatch):
    from eventwarden.models import sequence

    seen = {}

    class Learner:
        def __init__(self, **settings):
            pass

        def fit(self, ready):
            held = ready.groupBy(F.spark_partition_id()).count().collect()
            seen.update(most=max(r["count"] for r in held), rows=sum(r["count"] for r in held))

    monkeypatch.setattr(sequence, "MultilayerPerceptronClassifier", Learner)
    monkeypatch.setattr(sequence, "TASK_BYTES", 8 * 20 * 2 * 100, raising=False)
    train = spark.range(0, 3000, 1, 2).select(
        F.expr("array_repeat(array(float(id), float(1)), 1 + int(id % 20))").alias("window"), (F.col("id") % 2).alias("target"))
    _, means, _ = sequence.fit_sequence(train, 2)
    assert seen["rows"] == 3000 and seen["most"] <= 110
    assert means == sequence.step_scale(train, 2)[0]


def test_spread_makes_more_tasks_of_more_rows(spark, small, monkeypatch):
    from eventwarden import adapter, session

    monkeypatch.setattr(session, "SPREAD_ROWS", 50, raising=False)
    whole = adapter.table(spark, small, "events")
    rows = session.spread(whole, "event_id")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == whole.count() and max(sizes) < 100

    spread_columns = []

    def keep(df, key):
        spread_columns.append(set(df.columns))
        return session.spread(df, key)

    monkeypatch.setattr(adapter, "spread", keep)
    assert adapter.raw_items(spark, small).count() == whole.count()
    assert spread_columns == [set(whole.columns)]
