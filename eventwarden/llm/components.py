"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Every round hangs the larger neighbours of a node below its smallest one and then does the same
    with the smaller neighbours, so paths halve. Minima are aggregates and joins, never lists, and
    every round ends in a written table. Null ends and loops are no edges; an empty table gives none.
    """
    now = scratch.cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, as a join with an aggregate could not split the centre of a large star.
        low = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.cut(large.where("u <> v").distinct(), "large")
        scratch.drop(low)
        low = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        # A child goes below the smallest parent; so do its other parents.
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        then = scratch.cut(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        fresh = _mark(then)
        scratch.drop(now, large, low)
        now = then
        if fresh == mark:
            break
        mark = fresh
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(u, v) as decimal(38, 0))), 0)")).first()
    return tuple(row)
