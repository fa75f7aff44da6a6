"""Benchmark items inside documents: MinHash containment by item size, then exact shingles.

Items fall into classes by the size of their shingle set, a power of two each. For a class with sets of up
to U shingles a document is a row of windows of 2U shingles, each U after the other: a passage of the item lies
whole in one of them, however long the document is, so its similarity to that window is bounded from below.
The bound says how many MinHash samples make a miss less likely than one in a million. A window whose
sample equals the item's is a candidate, and candidates are checked on whole shingle sets:
containment is the share of the item's shingles that the document has.

Samples of items also stand in a bitmap of bounded size that every task holds; windows that hit no bit make no
row, so what is shuffled follows the hits and not the windows.

An item whose shingles are scattered over more than one window is not bound to be similar to any. Documents longer
than a window therefore also tell which item shingles they have, if these are enough for the smallest item. A document
that reaches the threshold has at least one of the (1 - threshold) share of an item's shingles, plus one, that the
fewest documents have; it becomes a candidate through these, so no scattered item is missed.

Words are runs of letters and digits, lower-cased; shingles have five of them. An item of fewer words is one
shingle. Items without words match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventwarden.llm.scratch import Scratch
from eventwarden.llm.words import byte_class, mixed, run_hashes, words_of

#: Bits of the bitmap of item samples: sixteen per sample within these bounds. 2**28 bits are 32 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Bytes of item samples and shingle sets up to which they are broadcast.
BROADCAST_BYTES = 16 << 20


def item_class(size: int) -> int:
    return size.bit_length() - 1


def samples_of(level: int, threshold: float, miss: float = 1e-6) -> int:
    """Samples a class needs: from the least similarity of an item to the window that holds it."""
    low, high = 1 << level, (2 << level) - 1
    shared = math.ceil(threshold * low)
    similar = shared / (2 * high + low - shared)
    return 1 if similar >= 1 else math.ceil(math.log(miss) / math.log(1 - similar))


def _draws(level: int, length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([44, level, length])
    factors = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factors, rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)


def _keys(minima: np.ndarray, level: int, length: int, sample: int) -> np.ndarray:
    name = np.uint64((level * 8 + length) * 1024 + sample + 1)
    return mixed(minima.astype(np.uint64) + mixed(np.array([name]))[0])


def _grams(found, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words inside rows, and row limits; shorter rows have none."""
    counts = np.diff(found.first)
    sizes = np.maximum(counts - length + 1, 0)
    limits = np.concatenate([[0], np.cumsum(sizes)])
    runs = run_hashes(found.hashes, length)
    index = np.arange(limits[-1]) + np.repeat(found.first[:-1] - limits[:-1], sizes)
    return runs[index], limits


def item_sets(length: int):
    """Arrow task over (id, text): the shingle set of every item, its shingle length, and its sample keys."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            rows = []
            for found in words_of(batch.column("text"), inside=byte_class(extra=True)):
                for row in range(len(found.first) - 1):
                    words = found.hashes[found.first[row]:found.first[row + 1]]
                    if len(words):
                        own = min(length, len(words))
                        rows.append((ids[found.rows.start + row], own, np.unique(run_hashes(words, own)).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["item", "length", "shingles"])

    return task


def item_samples(threshold: float):
    """Arrow task over (item, length, shingles): (key, item), a row per MinHash sample."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for item, length, values in zip(*(batch.column(c).to_pylist() for c in ("item", "length", "shingles")), strict=True):
                short = np.array(values, dtype=np.int64).view(np.uint64).astype(np.uint32)
                level = item_class(len(short))
                count = samples_of(level, threshold)
                factors, shifts = _draws(level, length, count)
                own = [_keys((((short ^ shifts[k]) * factors[k]).min())[None], level, length, k) for k in range(count)]
                keys.append(np.concatenate(own).view(np.int64))
                items.append(np.full(count, item, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(items))], ["key", "item"])

    return task


def _named(shingles: np.ndarray) -> np.ndarray:
    return mixed(shingles + np.uint64(0xD1B54A32D192ED03))


def item_shingles(length: int):
    """Arrow task over (item, length, shingles): (key, item, tag, size) of items that can be scattered.

    Those have two shingles and more. ``tag`` tells items apart that share an id.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for item, own, values in zip(*(batch.column(c).to_pylist() for c in ("item", "length", "shingles")), strict=True):
                if own == length and len(values) > 1:
                    keys = _named(np.array(values, dtype=np.int64).view(np.uint64))
                    columns[0].append(keys.view(np.int64))
                    for column, value in zip(columns[1:], (item, int(np.bitwise_xor.reduce(keys).view(np.int64)), len(values)), strict=True):
                        column.append(np.full(len(values), value, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["key", "item", "tag", "size"])

    return task


def window_hits(classes: list[tuple[int, int]], threshold: float, bitmap: bytes, words: int, shingle_bitmap: bytes):
    """Arrow task over (id, text): (id, key, scattered).

    Samples of all windows that hit ``bitmap``; and, of documents longer than the windows of the smallest
    class, the shingles that hit ``shingle_bitmap``, if they are enough for an item of that class.
    """
    several = [level for length, level in classes if length == words and level > 0]
    longer = 2 * ((2 << min(several)) - 1) if several else 0
    enough = math.ceil(threshold * (1 << min(several))) if several else 0

    def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        place = keys & np.uint64(64 * len(bits) - 1)
        return np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shingle_bits = np.frombuffer(bitmap, np.uint64), np.frombuffer(shingle_bitmap, np.uint64)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for found in words_of(batch.column("text"), inside=byte_class(extra=True)):
                out_ids, out_keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                grams = {length: _grams(found, length) for length in {n for n, _ in classes}}
                for length, level in classes:
                    hashes, limits = grams[length]
                    if not len(hashes):
                        continue
                    stride = (2 << level) - 1
                    per_row = -(-np.diff(limits) // stride)
                    owner = np.repeat(np.arange(len(per_row)), per_row)
                    first = np.concatenate([[0], np.cumsum(per_row)])
                    begins = limits[owner] + (np.arange(len(owner)) - first[owner]) * stride
                    joined = owner[1:] == owner[:-1]
                    short = hashes.astype(np.uint32)
                    work = np.empty_like(short)
                    factors, shifts = _draws(level, length, samples_of(level, threshold))
                    for k in range(len(factors)):
                        np.bitwise_xor(short, shifts[k], out=work)
                        np.multiply(work, factors[k], out=work)
                        minima = np.minimum.reduceat(work, begins)
                        # A window is a block and the next one of the same text.
                        minima[:-1] = np.where(joined, np.minimum(minima[:-1], minima[1:]), minima[:-1])
                        keys = _keys(minima, level, length, k)
                        hit = held(bits, keys)
                        if len(hit):
                            out_ids.append(ids[found.rows.start + owner[hit]])
                            out_keys.append(keys[hit].view(np.int64))
                windows = sum(map(len, out_keys))
                if several:
                    hashes, limits = grams[words]
                    keys = _named(hashes)
                    hit = held(shingle_bits, keys)
                    ends = np.searchsorted(hit, limits)
                    for row in np.flatnonzero((np.diff(limits) > longer) & (np.diff(ends) >= enough)):
                        own = np.unique(keys[hit[ends[row]:ends[row + 1]]])
                        if len(own) >= enough:
                            out_ids.append(np.full(len(own), ids[found.rows.start + row]))
                            out_keys.append(own.view(np.int64))
                flat = np.concatenate(out_keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_ids).astype(np.int64)), pa.array(flat), pa.array(np.arange(len(flat)) >= windows)],
                    ["id", "key", "scattered"])

    return task


def document_sets(lengths: list[int]):
    """Arrow task over (id, text): the shingle set of every document for each shingle length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for found in words_of(batch.column("text"), inside=byte_class(extra=True)):
                count = len(found.first) - 1
                for length in lengths:
                    hashes, limits = _grams(found, length)
                    sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(limits[:-1], limits[1:], strict=True)]
                    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(found.rows.start, count), pa.array(np.full(count, length, dtype=np.int32)),
                         pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))],
                        ["id", "length", "present"])

    return task


def bitmap_of(samples: DataFrame, count: int) -> bytes:
    """Bits of sample keys; collected as words, of which there are at most MOST_BITS / 64."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count - 1).bit_length()))
    words = samples.select(F.expr(f"key & {size - 1}L").alias("place")).groupBy(
        F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    bits = np.zeros(size // 64, dtype=np.int64)
    found = words.toArrow()
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.tobytes()


def _rarest(own: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(key, item): of every item the shingles that the fewest documents have, one more than it may lack."""
    counts = found.groupBy("key").agg(F.count("*").alias("n"))
    seen = own.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # A window per item: as many rows as the item has shingles.
    order = Window.partitionBy("item", "tag").orderBy("n", "key")
    percent = round(threshold * 100)
    return seen.withColumn("place", F.row_number().over(order)).where(
        f"place <= size - ceil({percent} * size / 100) + 1 and n > 0").select("key", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, item, n_item_shingles, n_shared, containment) of every document and item that reach the threshold.

    Null and empty texts, and rows with a null id on either side, match nothing. Documents that share an id are
    judged each and reported once, with the largest share; so are items. Empty tables give no rows.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item).cast("bigint").alias("id"), F.lower(F.col(item_text).cast("string")).alias("text"))
    sets = scratch.cut(wanted.where("id is not null").mapInArrow(
        item_sets(words), "item bigint, length int, shingles array<bigint>").distinct(), "items")
    shapes = sets.select("length", F.size("shingles").alias("n")).groupBy(
        "length", F.floor(F.log2("n")).cast("int").alias("level")).agg(
        F.count("*").alias("items"), F.sum("n").alias("n")).orderBy("length", "level").collect()
    classes = [(r["length"], r["level"]) for r in shapes]
    samples = scratch.cut(sets.mapInArrow(item_samples(threshold), "key bigint, item bigint").distinct(), "samples")
    count = samples.count()
    own = scratch.cut(sets.mapInArrow(item_shingles(words), "key bigint, item bigint, tag bigint, size bigint").distinct(), "shingles")
    # Every entry of a list is a number of eight bytes; a sample row has two.
    small = 8 * sum(r["n"] for r in shapes) + 16 * count <= BROADCAST_BYTES
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    lowered = rows.withColumn("text", F.lower("text"))
    shipped = spark.sparkContext.broadcast(
        (bitmap_of(samples, max(1, count)), bitmap_of(own, max(1, sum(r["n"] for r in shapes)))))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from window_hits(classes, threshold, shipped.value[0], words, shipped.value[1])(batches)

    found = scratch.cut(lowered.mapInArrow(hits, "id bigint, key bigint, scattered boolean").distinct(), "hits")
    pairs = found.where("not scattered").join(F.broadcast(samples) if small else samples, "key").select("id", "item")
    rare = scratch.cut(_rarest(own, found.where("scattered"), threshold), "rare")
    pairs = pairs.union(found.where("scattered").join(F.broadcast(rare) if small else rare, "key").select("id", "item"))
    pairs = scratch.cut(pairs.distinct(), "pairs")
    present = lowered.join(pairs.select("id").distinct(), "id", "left_semi").mapInArrow(
        document_sets(sorted({n for n, _ in classes}) or [words]), "id bigint, length int, present array<bigint>")
    lists = F.broadcast(sets) if small else sets
    checked = pairs.join(lists, "item").join(present, ["id", "length"]).select(
        "id", "item", F.size("shingles").cast("bigint").alias("size"),
        F.size(F.array_intersect("present", "shingles")).cast("bigint").alias("shared"))
    percent = round(threshold * 100)
    best = checked.where(f"100 * shared >= {percent} * size").groupBy("id", "item").agg(
        F.max(F.struct((F.col("shared") / F.col("size")).alias("part"), "shared", "size")).alias("best"))
    return best.select(F.col("id").alias(id), F.col("item").alias(item), F.col("best.size").alias("n_item_shingles"),
                       F.col("best.shared").alias("n_shared"), F.col("best.part").alias("containment"))
