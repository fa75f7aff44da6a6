"""Near-duplicate vectors by spherical caps: random product codes, joins on filters, exact cosines.

A filter is a direction put together from one random codeword per block of coordinates, after a random
rotation. The cap of a vector holds every direction whose inner product reaches a limit, however many they
are: they are found block by block, leaving out beginnings that the best rest cannot lift to the limit.
Several rotations make a missed pair unlikely. Vectors that share a filter are compared exactly, in double
precision.

The limit is fitted to the dimension, the number of codewords and the cosine, so that a pair at that cosine
is missed with the same small probability in every dimension and at every size, less above. Under a random
rotation that probability is the same for all pairs of one cosine, so pairs drawn at random measure it. The
number of codewords and of rotations are those of the least estimated work. A length that no more vectors have than
it has numbers has one filter, as a rotation would be larger than the vectors, and no pair is missed. Vectors
of one number are equal when their signs are.

Equal vectors are one class with a weight. A bucket is compared tile by tile, as matrix products in single
precision, and what they leave open in double;
a pair is counted in the first filter its vectors share, so nothing is counted twice and no pair becomes
a row: a task gives every vector its number of links and the smallest vector of its part.

Buckets are filled in rounds. A vector is sent once for each of its filters, many times its own size in all, but
only the rows of one round lie on disk at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.components import components
from eventwarden.llm.scratch import Scratch
from eventwarden.session import shuffles_end

#: Vectors of a bucket in one block; blocks of a larger bucket are compared in tasks of their own.
BLOCK_ROWS = 16_384
#: Vectors on a side of one matrix product.
TILE = 1024
#: Bytes of bucket rows in a round, before compression: these, or twice the vectors where that is more; and those of a task.
ROUND_BYTES, TASK_BYTES = 128_000_000, 64_000_000
#: Codewords of a block at most; more directions take more blocks.
WORDS = 2048
#: Probability that a pair at the wanted cosine shares no filter.
MISSED = 1e-4
#: Codes and pairs of each by which limits are fitted, and directions tried for each pair.
TRIED_CODES, TRIED_PAIRS, TRIED = 4, 1000, 64


class Caps(NamedTuple):
    blocks: int
    codewords: int
    turns: int
    #: Sum of block products from which a direction is listed.
    limit: float


def code_for(dimension: int, blocks: int, codewords: int, turn: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation and the codewords of every block, the same in every task."""
    rng = np.random.default_rng([dimension, codewords, turn])
    rotation, _ = np.linalg.qr(rng.standard_normal((dimension, dimension)))
    words = []
    for part in np.array_split(np.arange(dimension), blocks):
        block = rng.standard_normal((codewords, len(part)))
        words.append(block / np.linalg.norm(block, axis=1, keepdims=True))
    return rotation, words


def block_products(unit: np.ndarray, rotation: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
    turned = unit @ rotation
    low = np.cumsum([0] + [block.shape[1] for block in words])
    return [turned[:, a:b] @ block.T for a, b, block in zip(low[:-1], low[1:], words, strict=True)]


def decoded(unit: np.ndarray, caps: Caps, turn: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of direction) of every direction that reaches the limit, in one code, in order of rows."""
    if caps.codewords == 1:
        return np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
    code = code_for(unit.shape[1], caps.blocks, caps.codewords, turn)
    if caps.blocks == 1:
        found = [_reached(unit[low:low + step] @ code[0], code[1][0], caps.limit - 1e-9, low) for low in range(0, len(unit), step)]
    else:
        found = [_decoded(block_products(unit[low:low + step], *code), caps, low) for low in range(0, len(unit), step)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def rounding(dimension: int) -> float:
    """What a product of two vectors of length one can be off in single precision, at most."""
    return (dimension + 16) * 1.2e-7


def _reached(turned: np.ndarray, words: np.ndarray, limit: float, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of one block: sought in single precision, decided in double."""
    products = turned.astype(np.float32) @ words.astype(np.float32).T
    at, word = np.nonzero(products >= np.float32(limit - rounding(words.shape[1])))
    sure = np.einsum("ij,ij->i", turned[at], words[word]) >= limit
    return at[sure] + low, word[sure]


def _decoded(products: list[np.ndarray], caps: Caps, low: int) -> tuple[np.ndarray, np.ndarray]:
    tops = np.stack([p.max(axis=1) for p in products])
    # Rounding must not lose what just reaches the limit.
    limit = caps.limit - 1e-9
    rest = tops.sum(axis=0)
    rows = np.flatnonzero(rest >= limit)
    sums, names = np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int64)
    slack = rest - limit
    for product, top in zip(products, tops, strict=True):
        if not len(rows):
            break
        # Codewords that some direction at the limit can hold, beside the best of all other blocks.
        wide = max(1, int((product >= (top - slack)[:, None]).sum(axis=1).max()))
        if wide < caps.codewords:
            best = np.argpartition(-product, wide - 1, axis=1)[:, :wide]
            product = np.take_along_axis(product, best, 1)
        else:
            best = np.broadcast_to(np.arange(caps.codewords), product.shape)
        rest = rest - top
        value = sums[:, None] + product[rows]
        at, word = np.nonzero(value >= (limit - rest[rows])[:, None])
        sums, rows, names = value[at, word], rows[at], names[at] * caps.codewords + best[rows[at], word]
    return rows + low, names


def shared_limits(dimension: int, blocks: int, codewords: int, cosine: float) -> np.ndarray:
    """For random pairs at ``cosine``, the limit up to which they share a filter of one code; sorted.

    Only the best directions of the middle of a pair are tried, so a limit can be too low, never too high.
    """
    out = []
    for turn in range(TRIED_CODES):
        rng = np.random.default_rng([dimension, codewords, turn, 1])
        code = code_for(dimension, blocks, codewords, turn)
        for _ in range(0, TRIED_PAIRS, 125):
            one, two = rng.standard_normal((2, 125, dimension))
            one /= np.linalg.norm(one, axis=1, keepdims=True)
            two -= (one * two).sum(axis=1, keepdims=True) * one
            two /= np.linalg.norm(two, axis=1, keepdims=True)
            two = cosine * one + math.sqrt(max(0.0, 1 - cosine * cosine)) * two
            sums = None
            for p, q in zip(block_products(one, *code), block_products(two, *code), strict=True):
                best = np.argsort(-(p + q), axis=1)[:, :TRIED]
                pair = np.stack([np.take_along_axis(p, best, 1), np.take_along_axis(q, best, 1)])
                sums = pair if sums is None else (sums[..., :, None] + pair[..., None, :]).reshape(2, 125, -1)
                if sums.shape[2] > TRIED:
                    keep = np.argpartition(-sums.sum(axis=0), TRIED - 1, axis=1)[:, :TRIED]
                    sums = np.take_along_axis(sums, keep[None], 2)
            out.append(sums.min(axis=0).max(axis=1))
    return np.sort(np.concatenate(out))


@lru_cache(maxsize=4096)
def caps_for(dimension: int, size: int, cosine: float, missed: float = MISSED) -> Caps:
    """Codewords, turns and limit for ``size`` vectors: of all that miss a pair with probability ``missed``, the cheapest."""
    single = Caps(1, 1, 1, -math.inf)
    if size <= dimension or dimension == 1:
        return single
    # Microseconds for each vector: a copy in a bucket, a comparison, a bucket of several.
    copy, compare, bucket = 5 + 0.08 * dimension, 4e-5 * dimension + 1e-3, 100
    best, least = single, math.inf
    sample = np.random.default_rng(dimension).standard_normal((64, dimension))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    for blocks in range(1, max(1, dimension // 2) + 1):
        codewords = min(WORDS, math.ceil((64 * size) ** (1 / blocks)))
        before, last = least, math.inf
        while codewords > 1:
            limits = shared_limits(dimension, blocks, codewords, cosine)
            listing = codewords * (5e-5 * dimension + 1e-3 if blocks == 1 else 1.2e-4 * dimension + 0.006 * blocks)
            cheapest = math.inf
            for turns in (4, 8, 16):
                # Turns are independent: a pair is missed when it is missed in all.
                limit = float(limits[int(len(limits) * missed ** (1 / turns))])
                caps = Caps(blocks, codewords, turns, limit)
                entries = len(decoded(sample, caps, 0)[0]) / len(sample)
                others = size * entries / codewords ** blocks
                copies = max(1.0, others / BLOCK_ROWS) * copy + bucket * (1 - math.exp(-others)) / (1 + others)
                cost = turns * (listing + entries * (3 + copies + compare * others))
                cheapest = min(cheapest, cost)
                if cost < least:
                    best, least = caps, cost
            if cheapest > last:
                break
            last = cheapest
            codewords = int(codewords / (4 if blocks == 1 else 16) ** (1 / blocks))
        if least == before:
            break
    return best


def vectors_by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of every length in a batch; null and empty vectors and those with no direction are left out."""
    lists = batch.column("vector")
    limits = lists.offsets.to_numpy()
    values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(limits), 0)
    for dimension in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dimension)
        matrix = values[limits[rows][:, None] + np.arange(dimension)]
        with np.errstate(all="ignore"):
            scale = np.abs(matrix).max(axis=1)
        usable = np.isfinite(scale) & (scale > 0)
        if usable.any():
            yield rows[usable], matrix[usable]


def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task over (id, vector): a digest of every usable vector."""
    for batch in batches:
        found: list[bytes | None] = [None] * len(batch)
        for rows, matrix in vectors_by_size(batch):
            # All vectors of one number and sign have cosine 1: they are one class.
            for r, line in zip(rows, (units(matrix) if matrix.shape[1] == 1 else matrix) + 0.0, strict=True):
                found[r] = hashlib.md5(line.tobytes()).digest()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "print"])


def filter_lists(plans: dict[int, Caps]):
    """Arrow task over (id, weight, vector), all usable: the sorted filters of every vector."""
    number = {dimension: n for n, dimension in enumerate(sorted(plans))}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filters: list[np.ndarray | None] = [None] * len(batch)
            for rows, matrix in vectors_by_size(batch):
                dimension = matrix.shape[1]
                unit = units(matrix)
                caps = plans[dimension]
                found = [decoded(unit, caps, t) for t in range(caps.turns)]
                places = np.concatenate([r for r, _ in found])
                names = np.concatenate([f + caps.codewords ** caps.blocks * t for t, (_, f) in enumerate(found)])
                # Vectors of different dimension never meet.
                names = names * len(plans) + number[dimension]
                order = np.lexsort((names, places))
                own = np.split(names[order], np.searchsorted(places[order], np.arange(1, len(rows))))
                for r, some in zip(rows, own, strict=True):
                    filters[r] = some
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(filters, pa.list_(pa.int64()))], [*batch.schema.names, "filters"])

    return task


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def bucket_links(cosine: float):
    """Arrow task over bucket rows in order of (filter, x, y): links and smallest linked part of each row.

    Rows with no links only tie parts of a bucket together.
    """

    def met_before(name: int, known: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which rows ``one`` share a filter before ``name`` with which rows ``two``."""
        sides = []
        for rows in (one, two):
            counts = ends[rows + 1] - ends[rows]
            places = np.repeat(ends[rows] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            at, held = np.repeat(np.arange(len(rows)), counts), known[places]
            sides.append((at[held < name], held[held < name]))
        both = np.intersect1d(sides[0][1], sides[1][1])
        shared = np.zeros((len(one), len(two)), dtype=bool)
        for low in range(0, len(both), TILE):
            some = both[low:low + TILE]
            has = []
            for rows, (at, held) in zip((one, two), sides, strict=True):
                column = np.minimum(np.searchsorted(some, held), len(some) - 1)
                use = some[column] == held
                table = np.zeros((len(rows), len(some)), dtype=np.float32)
                table[at[use], column[use]] = 1
                has.append(table)
            shared |= has[0] @ has[1].T > 0
        return shared

    def one(name: int, ids, sides, weights, unit, known, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, links, smaller id of its part) of what is linked."""
        single, slack = unit.astype(np.float32), rounding(unit.shape[1])
        links, low, tied = np.zeros(len(ids), np.int64), ids.copy(), []
        # Between two blocks, only pairs across them; each block has a task of its own.
        halves = [np.flatnonzero(sides == side) for side in np.unique(sides)]
        tiles = [[half[k:k + TILE] for k in range(0, len(half), TILE)] for half in halves]
        if len(halves) > 1:
            meetings = ((a, b) for a in tiles[0] for b in tiles[1])
        else:
            meetings = ((a, b) for k, a in enumerate(tiles[0]) for b in tiles[0][k:])
        for a, b in meetings:
            same = a is b
            products = single[a] @ single[b].T
            near = products >= np.float32(cosine - slack)
            if same:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            at, to = np.nonzero(near & (products < np.float32(cosine + slack)))
            for k in range(0, len(at), BLOCK_ROWS):
                i, j = at[k:k + BLOCK_ROWS], to[k:k + BLOCK_ROWS]
                near[i, j] = np.einsum("ij,ij->i", unit[a[i]], unit[b[j]]) >= cosine
            near &= ids[a][:, None] != ids[b][None, :]
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(rows):
                continue
            a, b, near = a[rows], b[columns], near[np.ix_(rows, columns)]
            near &= ~met_before(name, known, ends, a, b)
            links[a] += near @ weights[b]
            # A tile against itself holds every pair both ways.
            if not same:
                links[b] += weights[a] @ near
            settled = False
            while not settled:
                settled = True
                for to, of, linked in ((a, b, near), (b, a, near.T)):
                    was = low[to]
                    now = np.minimum(was, np.where(linked, low[of][None, :], np.iinfo(np.int64).max).min(axis=1))
                    lower = now < was
                    settled &= not lower.any()
                    # A row's own step down shows in its last one; a step of what it had joined before does not.
                    tied.append(np.stack([was, now])[:, lower & (was != ids[to])])
                    low[to] = now
        some = links > 0
        ties = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *tied], axis=1), axis=1)
        return (np.concatenate([ids[some], ties[0]]), np.concatenate([links[some], np.zeros(ties.shape[1], np.int64)]),
                np.concatenate([low[some], ties[1]]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            table = table.combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("filter", "x", "y")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if not len(cuts):
                held = table
                continue
            held = table.slice(cuts[-1])
            yield from groups(table.slice(0, cuts[-1]), np.concatenate([[0], cuts]))
        if held is not None and len(held):
            yield from groups(held.combine_chunks(), np.array([0, len(held)]))

    def groups(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        ids, sides, weights, names = (table.column(c).to_numpy() for c in ("id", "block", "weight", "filter"))
        vectors, filters = table.column("vector").combine_chunks(), table.column("filters").combine_chunks()
        values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        limits, known = vectors.offsets.to_numpy(), filters.values.to_numpy()
        ends = filters.offsets.to_numpy()
        who, count, low = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            dimension = limits[a + 1] - limits[a]
            unit = units(values[limits[a]:limits[b]].reshape(b - a, dimension))
            found = one(names[a], ids[a:b], sides[a:b], weights[a:b], unit, known, ends[a:b + 1])
            for kept, part in zip((who, count, low), found, strict=True):
                kept.append(part)
        empty = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(empty + x).astype(np.int64)) for x in (who, count, low)], ["id", "links", "low"])

    return task


def near_vectors(vectors: DataFrame, scratch: Scratch, id: str = "vec_id", vector: str = "embedding",
                 cosine: float = 0.95, missed: float = MISSED) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing, and so do rows
    with a null id. Vectors of different length are never compared. Rows that share an id are one node.
    """
    with shuffles_end(vectors.sparkSession):
        nodes = _linked(vectors, scratch, id, vector, cosine, missed)
    return vectors.select(F.col(id).cast("bigint").alias("id")).join(nodes, "id", "left").select(
        F.col("id").alias(id), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def _linked(vectors: DataFrame, scratch: Scratch, id: str, vector: str, cosine: float, missed: float) -> DataFrame:
    """(id, links, component) of every id with a usable vector; all work is done and written."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    # Single precision is kept as it comes: what is sent for a vector is mostly the vector.
    kind = kind if kind == "float" else "double"
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    # A null component becomes NaN, which no usable vector holds.
    rows = rows.withColumn("vector", F.expr(f"transform(vector, v -> coalesce(v, {kind}('NaN')))")).where("id is not null")
    sizes = rows.where("size(vector) > 0").groupBy(F.size("vector").alias("dimension")).count().collect()
    plans = {r["dimension"]: caps_for(r["dimension"], r["count"], cosine, missed) for r in sizes}
    marked = rows.mapInArrow(prints, f"id bigint, vector array<{kind}>, print binary").where("print is not null")
    # Aggregates are written before they are joined, so that a print or filter of very many rows can be split.
    named = scratch.cut(marked.select("id", "print"), "prints")
    classes = scratch.cut(named.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    members = scratch.cut(named.join(classes, "print").select("id", "rep", "weight"), "members")
    scratch.drop(named)
    firsts = marked.join(classes, "print").where("id = rep").dropDuplicates(["print", "id"]).select("id", "weight", "vector")
    reps = scratch.cut(firsts.mapInArrow(
        filter_lists(plans), f"id bigint, weight bigint, vector array<{kind}>, filters array<bigint>"), "reps")
    scratch.drop(classes)

    found = _compared(reps, scratch, kind, cosine)
    scratch.drop(reps)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("low").alias("a"), F.col("id").alias("b")), scratch)
    placed = links.join(parts.withColumnRenamed("node", "id"), "id", "full").withColumnRenamed("id", "rep")
    placed = scratch.cut(placed, "placed")
    nodes = members.join(placed, "rep", "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    nodes = scratch.cut(nodes.distinct().groupBy("id").agg(F.sum("links").alias("links"), F.min("component").alias("component")), "nodes")
    scratch.drop(members, placed)
    return nodes


def _compared(reps: DataFrame, scratch: Scratch, kind: str, cosine: float) -> DataFrame:
    """(id, links, low) of all buckets, a round of them at a time: rows of the largest round lie on disk, not all."""
    entries = reps.select("*", F.explode("filters").alias("filter"))
    counts = entries.groupBy("filter").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS))
    large = scratch.cut(counts.where("blocks > 1"), "large")
    number = {"float": 4, "double": 8}[kind]
    count, own, listed = reps.agg(F.count("*"), F.sum(F.size("vector")), F.sum(F.size("filters"))).first()
    if not count:
        return scratch.cut(reps.select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("low")), "found")
    copies = large.agg(F.sum(F.col("n") * (F.col("blocks") - 1))).first()[0]
    sent = listed + (copies or 0)
    row = 64 + (number * own + 8 * listed) / count
    rounds = max(1, math.ceil(sent * row / max(ROUND_BYTES, 2 * number * own)))
    if copies:
        entries = entries.join(F.broadcast(large.select("filter", "blocks")), "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        entries = entries.withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
        entries = entries.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumns(
            {"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    else:
        entries = entries.withColumns({c: F.lit(0).cast("bigint") for c in ("block", "x", "y")})
    parts = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(sent * row / rounds / TASK_BYTES))
    found = []
    for turn in range(rounds):
        rows = entries.where(F.pmod(F.xxhash64("filter", "x", "y"), F.lit(rounds)) == turn)
        rows = rows.repartition(parts, "filter", "x", "y").sortWithinPartitions("filter", "x", "y", "id")
        found.append(scratch.cut(rows.select("filter", "x", "y", "block", "id", "weight", "vector", "filters").mapInArrow(
            bucket_links(cosine), "id bigint, links bigint, low bigint"), "found"))
    scratch.drop(large)
    return reduce(DataFrame.unionByName, found)
