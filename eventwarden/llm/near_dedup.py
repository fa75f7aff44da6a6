"""Near-duplicate documents: banded MinHash, odd sketches, exact shingle sets, components.

1. Every text becomes the set of its distinct word shingles. Texts with equal sets are one class,
   found by a fingerprint of the set; only class representatives go on.
2. MinHash samples of a representative give its band keys. The same samples, folded into a bitmap
   by parity, are its odd sketch: the bits that differ between two sketches tell how many samples
   differ, and so the similarity, most precisely where it is high.
3. Every representative is compared with the smallest one it shares a bucket of a band with. Pairs the
   sketches call similar enough, within five standard errors, are confirmed on their full sets.
4. Links only matter between different components. Buckets that still hold several of them are
   compared pair by pair across components, split into blocks of bounded size. So a large group of
   copies costs as many comparisons as it has members, and no link between components is lost.

Null ids take no part: they have sizes, no component, and are kept. Rows that share an id are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.components import components
from eventwarden.llm.scratch import Scratch
from eventwarden.llm.words import mixed, shingles, words_of

SKETCH_WORDS = 8
FOLD_WORDS = 32
BLOCK = 1024

#: Parity bitmaps of a text: s of its MinHash samples, f of its whole shingle set.
BITS = [f"s{i}" for i in range(SKETCH_WORDS)] + [f"f{i}" for i in range(FOLD_WORDS)]

#: What equal shingle sets have in common, and the parts the copies of one set are dealt over.
PRINT = ["print_a", "print_b", "n_shingles"]
PARTS = 256

SIGNATURES = ("id bigint, n_shingles bigint, print_a bigint, print_b bigint, bands array<bigint>, "
              + ", ".join(f"{name} bigint" for name in BITS))


class Banding(NamedTuple):
    """Band sizes for a similarity: a pair at the threshold is missed once in a million."""

    threshold: float
    rows: int
    bands: int

    @classmethod
    def of(cls, threshold: float, rows: int = 6, miss: float = 1e-6) -> Banding:
        return cls(threshold, rows, math.ceil(math.log(miss) / math.log(1 - threshold ** rows)))

    @property
    def samples(self) -> int:
        return self.rows * self.bands

    def most_bits(self) -> int:
        """Differing sketch bits up to which a pair may reach the threshold: five standard errors."""
        bits = 64 * SKETCH_WORDS
        differ = 2 * self.samples * (1 - self.threshold)
        differ += 5 * 2 * math.sqrt(self.samples * self.threshold * (1 - self.threshold))
        share = (1 - math.exp(-2 * differ / bits)) / 2
        return min(bits, math.ceil(bits * share + 5 * math.sqrt(bits * share * (1 - share))))


def signature_of(banding: Banding, length: int):
    """Arrow task: fingerprints, band keys and odd sketches of (id, text)."""
    rng = np.random.default_rng(88)
    factors = rng.integers(0, 1 << 31, banding.samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, banding.samples, dtype=np.uint64).astype(np.uint32)

    def sketch(mins: np.ndarray) -> np.ndarray:
        place = np.arange(mins.shape[0], dtype=np.uint64)[:, None] << np.uint64(32)
        bits = mixed(place | mins) % np.uint64(64 * SKETCH_WORDS)
        out = np.zeros((SKETCH_WORDS, mins.shape[1]), dtype=np.uint64)
        columns = np.arange(mins.shape[1])
        for row in bits:
            out[row >> np.uint64(6), columns] ^= np.uint64(1) << (row & np.uint64(63))
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for found in words_of(batch.column("text"), lower=True):
                hashes, limits = shingles(found, length)
                count = len(limits) - 1
                folds = np.zeros((FOLD_WORDS, count), dtype=np.uint64)
                sizes = np.zeros(count, dtype=np.int64)
                prints = np.zeros((2, count), dtype=np.uint64)
                for r in range(count):
                    if limits[r + 1] > limits[r]:
                        own = np.unique(hashes[limits[r]:limits[r + 1]])
                        sizes[r] = len(own)
                        odd = np.bincount((own >> np.uint64(20)) % np.uint64(64 * FOLD_WORDS), minlength=64 * FOLD_WORDS) & 1
                        folds[:, r] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
                        prints[0, r] = own.sum(dtype=np.uint64)
                        prints[1, r] = (own * (own >> np.uint64(32) | np.uint64(1))).sum(dtype=np.uint64)
                some = np.flatnonzero(sizes > 0)
                bands = np.zeros((banding.bands, count), dtype=np.uint64)
                bits = np.zeros((SKETCH_WORDS, count), dtype=np.uint64)
                if len(some):
                    short = hashes.astype(np.uint32)
                    begins = limits[some]
                    mins = np.empty((banding.samples, len(some)), dtype=np.uint64)
                    work = np.empty_like(short)
                    for k in range(banding.samples):
                        np.bitwise_xor(short, shifts[k], out=work)
                        np.multiply(work, factors[k], out=work)
                        mins[k] = np.minimum.reduceat(work, begins)
                    bits[:, some] = sketch(mins)
                    keys = np.zeros((banding.bands, len(some)), dtype=np.uint64)
                    for k in range(banding.rows):
                        keys = mixed(keys * np.uint64(31) + mins[k::banding.rows] + np.uint64(k + 1))
                    bands[:, some] = mixed(keys + np.arange(banding.bands, dtype=np.uint64)[:, None])
                full = sizes > 0
                starts = np.concatenate([[0], np.cumsum(np.where(full, banding.bands, 0))]).astype(np.int32)
                flat = pa.array(bands.T[full].ravel().view(np.int64))
                columns = [ids.slice(found.rows.start, count), pa.array(sizes),
                           pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                           pa.ListArray.from_arrays(pa.array(starts), flat)]
                columns += [pa.array(row.view(np.int64)) for row in (*bits, *folds)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "print_a", "print_b", "bands", *BITS])

    return task


def shingle_sets(length: int):
    """Arrow task: the sorted set of shingle hashes of (id, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for found in words_of(batch.column("text"), lower=True):
                hashes, limits = shingles(found, length)
                sets = [np.unique(hashes[limits[r]:limits[r + 1]]).view(np.int64) for r in range(len(limits) - 1)]
                starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(found.rows.start, len(sets)), pa.ListArray.from_arrays(pa.array(starts), flat)],
                    ["id", "shingles"])

    return task


def near_duplicates(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text",
                    words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``.

    Empty and null texts have no shingles and link with nothing; texts of fewer than ``words`` words
    are one shingle. The threshold is kept exactly: intersection >= threshold * union in hundredths.
    """
    banding = Banding.of(threshold)
    plain = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    signed = scratch.cut(plain.mapInArrow(signature_of(banding, words), SIGNATURES), "signatures")

    # Copies of a text are first reduced by parts of their ids, so a class of any size is spread over tasks.
    signed = signed.withColumn("part", F.expr(f"pmod(xxhash64(id), {PARTS})"))
    nodes = signed.where("id is not null and n_shingles > 0")
    copies = scratch.cut(nodes.groupBy(*PRINT, "part").agg(F.min("id").alias("least"), F.count("*").alias("n")), "copies")
    classes = scratch.cut(copies.groupBy(*PRINT).agg(F.min("least").alias("rep"), F.sum("n").alias("n")), "classes")
    reps = classes.select(F.col("rep").alias("id")).distinct()
    known = nodes.join(reps, "id", "left_semi")
    sketches = scratch.cut(known.select("id", "n_shingles", *BITS), "sketches")
    banded = scratch.cut(known.select("id", F.explode("bands").alias("key")), "bands")

    # Only buckets of several members go on; every member against the smallest it shares a bucket with.
    # Written, as a join with an aggregate could not split a key that very many texts share.
    heads = scratch.cut(banded.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last"), "heads")
    shared = scratch.cut(banded.join(heads.select("key", "a"), "key"), "shared")
    scratch.drop(banded)
    stars = shared.where("a < id").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a"))
    first = scratch.cut(_confirmed(plain, _promising(stars, sketches, banding), words, threshold, scratch), "links")
    found = components(first, scratch)

    # Buckets that still hold several components: the members of different ones, block by block.
    parts = scratch.cut(
        shared.select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
        .select("key", "id", F.coalesce("component", "id").alias("component")), "parts")
    scratch.drop(shared)
    open_buckets = scratch.cut(parts.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high"), "open")
    open_rows = parts.join(open_buckets.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "key")
    open_rows = open_rows.join(sketches, "id").withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    spread = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block",
        "id", "component", "n_shingles", *BITS)
    left, right = spread.alias("l"), spread.alias("r")
    cross = left.join(right, F.expr(
        "l.key = r.key and l.x = r.x and l.y = r.y and l.id < r.id and l.component <> r.component "
        "and (l.block <> r.block or l.x = l.y) and " + _similar("l", "r", banding))).select(
        F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    cross = cross.join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = scratch.cut(_confirmed(plain, cross, words, threshold, scratch), "links")
    whole = found
    if not second.isEmpty():
        stars = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        whole = components(stars.unionByName(second.select("a", "b")), scratch)
    scratch.drop(parts)
    # Only classes whose component is not the id itself go back to the rows.
    placed = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select(
        *PRINT, "rep", "n", F.coalesce("component", "rep").alias("component")).where("n > 1 or component <> rep")
    placed = copies.select(*PRINT, "part").join(placed.select(*PRINT, "component"), PRINT)
    return signed.select("id", *PRINT, "part").join(placed, [*PRINT, "part"], "left").select(
        F.col("id").alias(id), "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def _similar(a: str, b: str, banding: Banding) -> str:
    """Sizes that allow the threshold, sample sketches that do not rule it out, and whole-set folds.

    Two shingles in one place of a fold cancel, so the differing bits of two folds never outnumber the
    shingles in which the sets differ: the last test drops no pair that reaches the threshold.
    """
    percent = round(banding.threshold * 100)

    def differ(kind: str, count: int) -> str:
        return " + ".join(f"bit_count({a}.{kind}{i} ^ {b}.{kind}{i})" for i in range(count))

    return (f"100 * least({a}.n_shingles, {b}.n_shingles) >= {percent} * greatest({a}.n_shingles, {b}.n_shingles) "
            f"and {differ('s', SKETCH_WORDS)} <= {banding.most_bits()} "
            f"and {100 + percent} * ({differ('f', FOLD_WORDS)}) <= {100 - percent} * ({a}.n_shingles + {b}.n_shingles)")


def _promising(pairs: DataFrame, sketches: DataFrame, banding: Banding) -> DataFrame:
    a = sketches.select([F.col(c).alias(f"a_{c}") for c in sketches.columns])
    b = sketches.select([F.col(c).alias(f"b_{c}") for c in sketches.columns])
    joined = pairs.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id"))
    rule = _similar("a", "b", banding).replace("a.", "a_").replace("b.", "b_")
    return joined.where(rule).select("a", "b").distinct()


def _confirmed(plain: DataFrame, pairs: DataFrame, words: int, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold. Only texts of the pairs are shuffled."""
    pairs = scratch.cut(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = scratch.cut(plain.join(wanted, "id", "left_semi").mapInArrow(
        shingle_sets(words), "id bigint, shingles array<bigint>"), "sets")
    percent = round(threshold * 100)
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = joined.select("a", "b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("same"),
                         (F.size("x") + F.size("y")).cast("bigint").alias("total"))
    return both.where(f"100 * same >= {percent} * (total - same)").select("a", "b").distinct()
