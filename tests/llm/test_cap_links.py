"""Filters of vectors: a pair is missed as rarely in every dimension and at every size."""

import time

import numpy as np
import pytest

from eventwarden.llm import cap_links
from eventwarden.llm.scratch import Scratch


def pairs(dimension, count, cosine=0.95):
    rng = np.random.default_rng(dimension)
    one, two = rng.standard_normal((2, count, dimension))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    two -= (one * two).sum(axis=1, keepdims=True) * one
    two /= np.linalg.norm(two, axis=1, keepdims=True)
    return one, cosine * one + np.sqrt(1 - cosine * cosine) * two


@pytest.mark.parametrize("dimension, size", [
    (64, 60_000), (64, 1_000_000), (64, 10_600_000), (64, 100_000_000), (3, 100_000), (5, 1_000_000), (8, 50_000), (8, 1_000_000), (16, 1_000_000)])
def test_pairs_share_a_filter(dimension, size):
    one, two = pairs(dimension, 4000)
    caps = cap_links.caps_for(dimension, size, 0.95)
    assert caps.codewords > 1
    span = caps.codewords ** caps.blocks
    left = np.arange(len(one))
    for turn in range(caps.turns):
        if len(left):
            sides = [row * span + name for row, name in (cap_links.decoded(x[left], caps, turn) for x in (one, two))]
            left = np.delete(left, np.unique(np.intersect1d(*sides) // span))
    # 0.4 pairs are expected.
    assert len(left) <= 4


def test_every_direction_at_the_limit_is_listed():
    one, _ = pairs(12, 40)
    caps = cap_links.Caps(3, 9, 1, 1.2)
    parts = cap_links.block_products(one, *cap_links.code_for(12, 3, 9, 0))
    sums = (parts[0][:, :, None, None] + parts[1][:, None, :, None] + parts[2][:, None, None, :]).reshape(40, -1)
    rows, names = cap_links.decoded(one, caps, 0, step=7)
    assert sorted(zip(rows.tolist(), names.tolist(), strict=True)) == list(zip(*(x.tolist() for x in np.nonzero(sums >= 1.2)), strict=True))


@pytest.mark.parametrize("dimension", [8, 64])
def test_links_of_a_large_plan(spark, monkeypatch, dimension):
    plan = cap_links.caps_for
    monkeypatch.setattr(cap_links, "caps_for", lambda d, size, cosine, missed: plan(d, 1_000_000, cosine, missed))
    one, two = pairs(dimension, 300, 0.951)
    unit = np.concatenate([one, two])
    near = unit @ unit.T >= 0.95
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(unit)]
    found = cap_links.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), Scratch(spark, "t")).collect()
    assert {r.vec_id: r.n_links for r in found} == {n: int(near[n].sum()) - 1 for n in range(len(unit))}


def test_lengths_far_apart_never_meet(spark):
    rows = [(n, [1.0] * size) for n, size in enumerate([1, 1, 8193, 8193, 2])]
    found = cap_links.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), Scratch(spark, "t")).collect()
    assert sorted((r.vec_id, r.n_links) for r in found) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0)]


def clustered(count=420, dimension=16):
    """Chains in which only neighbours are near, tight groups and single vectors, in mixed order."""
    rng = np.random.default_rng(5)
    out = list(rng.standard_normal((count // 3, dimension)))
    for _ in range(2):
        one, two = np.linalg.qr(rng.standard_normal((dimension, 2)))[0].T
        out += [np.cos(0.25 * k) * one + np.sin(0.25 * k) * two for k in range(12)]
    while len(out) < count:
        middle = rng.standard_normal(dimension)
        out += list(middle + rng.standard_normal((40, dimension)) * 0.1)
    out = np.array(out[:count])[rng.permutation(count)]
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def by_force(unit):
    """Links and the smallest vector that links lead to."""
    near = unit @ unit.T >= 0.95
    low = np.arange(len(unit))
    while True:
        then = np.where(near, low[None, :], len(unit)).min(axis=1)
        if (then == low).all():
            return {n: (int(near[n].sum()) - 1, int(low[n])) for n in range(len(unit))}
        low = then


class Watched(Scratch):
    def cut(self, df, name="cut"):
        self.names = [*getattr(self, "names", []), name]
        return super().cut(df, name)


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = [found.apply(k).getName() for k in range(found.size())]
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


@pytest.mark.parametrize("block, tile", [(16_384, 1024), (48, 16)])
def test_buckets_fill_in_rounds(spark, monkeypatch, block, tile):
    """No round holds all copies of the vectors, what it shuffled goes with it, and results do not change."""
    plan = cap_links.caps_for
    monkeypatch.setattr(cap_links, "caps_for", lambda d, size, cosine, missed: plan(d, 1_000_000, cosine, missed))
    for name, value in (("BLOCK_ROWS", block), ("TILE", tile), ("ROUND_BYTES", 1)):
        monkeypatch.setattr(cap_links, name, value)
    unit = clustered()
    rows = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(unit)], "vec_id bigint, embedding array<double>")
    before, scratch = shuffle_files(spark), Watched(spark, "t")
    found = cap_links.near_vectors(rows, scratch)
    left = set()
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert scratch.names.count("found") > 3 and not left
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == by_force(unit)


def test_single_precision_is_sent_as_it_comes(spark):
    rows = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(clustered(60))], "vec_id bigint, embedding array<float>")
    scratch = Watched(spark, "t")
    seen = {}
    cut = Scratch.cut
    scratch.cut = lambda df, name="cut": (seen.setdefault(name, df.schema), cut(scratch, df, name))[1]
    found = cap_links.near_vectors(rows, scratch)
    assert seen["reps"]["vector"].dataType.simpleString() == "array<float>" and "vector" not in seen["prints"].names
    exact = np.array([r.embedding for r in rows.orderBy("vec_id").collect()])
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == by_force(exact / np.linalg.norm(exact, axis=1, keepdims=True))
