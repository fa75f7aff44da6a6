"""Word passages that repeat across documents, by levels of doubled length.

Windows of half the wanted length that occur in two documents are extended to the wanted length; a window
can only repeat if both of its halves do. What repeats there is extended again and again, until nothing does.

* The first level is half the wanted length. Of each stretch of windows that a wanted window can
  contain, only the one with the smallest hash is looked at. Two documents that share a wanted
  window choose the same one in it, so nothing is lost, and few rows are shuffled.
* At the wanted length, every window around a repeated first-level window is a candidate, named by the
  hashes of its two halves. Each is compared with the smallest document id that has it.
* What is removed depends on windows of the wanted length only. Longer levels (``longer_levels``) tell how long
  the repeated passages are. Each takes windows all of whose parts of the wanted length are candidates and which hold a
  repeated window of the level below, of them the one with the smallest hash in every stretch of a quarter of its
  length. It ends when no window repeats.

Exact copies are judged through the one with the smallest id, whose windows alone are compared.

Texts are not copied, and are shuffled only to join those that ``listed_rows`` finds likely to have an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.scratch import Scratch, in_parts
from eventwarden.llm.words import byte_class, mixed, run_hashes, words_of

#: Words of 64 bits in the filter of rows that may have an entry.
FILTER_WORDS = 1 << 18


def chosen(hashes: np.ndarray, count: int) -> np.ndarray:
    """Places of the smallest of every ``count`` consecutive hashes, the leftmost among equals."""
    size = len(hashes) - count + 1
    if size < 1:
        return np.zeros(0, dtype=np.int64)
    best = hashes[:len(hashes)].copy()
    place = np.arange(len(hashes))
    width = 1
    # Minima of runs whose width doubles, then one overlap for the rest.
    while 2 * width <= count:
        other, spot = best[width:], place[width:]
        mine, own = best[:len(other)], place[:len(other)]
        left = mine <= other
        best, place = np.where(left, mine, other), np.where(left, own, spot)
        width *= 2
    if width < count:
        shift = count - width
        other, spot = best[shift:shift + size], place[shift:shift + size]
        mine, own = best[:size], place[:size]
        place = np.where(mine <= other, own, spot)
    return place[:size]


def _rows(found) -> Iterator[tuple[int, np.ndarray]]:
    for row in range(len(found.first) - 1):
        yield row, found.hashes[found.first[row]:found.first[row + 1]]


def window_choice(half: int, wanted: int):
    """Arrow task over (id, tag, print, text): the chosen half windows of every text, each once, as ``keys``."""
    count = wanted - half + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in words_of(batch.column("text")):
                keys = []
                for _, words in _rows(found):
                    runs = run_hashes(words, half) if len(words) >= wanted else np.zeros(0, np.uint64)
                    keys.append(np.unique(runs[np.unique(chosen(runs, count))]).view(np.int64))
                limits = np.concatenate([[0], np.cumsum([len(own) for own in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(limits), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
                part = batch.slice(found.rows.start, found.rows.stop - found.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("id", "tag", "print")], lists], ["id", "tag", "print", "keys"])

    return task


def candidate_windows(half: int, wanted: int, levels: bool):
    """Arrow task over (id, tag, text, keys): windows whose chosen half is among ``keys``, with their places.

    With ``levels`` also the ``longer_windows`` around them.
    """
    count = wanted - half + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_numpy()
            lists = batch.column("keys")
            limits = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for found in words_of(batch.column("text")):
                out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
                spots, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
                for row, words in _rows(found):
                    at = found.rows.start + row
                    known = np.sort(values[limits[at]:limits[at + 1]])
                    runs = run_hashes(words, half)
                    if len(words) < wanted or not len(known):
                        continue
                    near = np.minimum(np.searchsorted(known, runs), len(known) - 1)
                    hit = known[near] == runs
                    candidate = hit[chosen(runs, count)]
                    places = np.flatnonzero(candidate)
                    given = [(wanted, places, runs[places], runs[places + wanted - half])]
                    for length, places, heads, tails in given + list(longer_windows(words, candidate, wanted) if levels else ()):
                        out[0].append(heads.view(np.int64))
                        out[1].append(tails.view(np.int64))
                        out[2].append(np.full(len(places), ids[at], dtype=np.int64))
                        out[3].append(np.full(len(places), tags[at], dtype=np.int64))
                        spots.append(places.astype(np.int32))
                        lengths.append(np.full(len(places), length, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (*out, spots, lengths)],
                    ["head", "tail", "id", "tag", "place", "length"])

    return task


def longer_windows(words: np.ndarray, candidate: np.ndarray, wanted: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, places, head and tail hashes) of windows of 2 * wanted, 4 * wanted, ... words.

    Only windows whose parts of ``wanted`` words are all candidates. Of a quarter of a length of neighbouring windows only
    the one with the smallest hash is given, so documents that share 5/4 of a length give the same one.
    """
    sums = np.concatenate([[0], np.cumsum(candidate)])
    length = 2 * wanted
    while len(words) >= length:
        parts = length - wanted + 1
        whole = sums[parts:] - sums[:-parts] == parts
        if not whole.any():
            return
        half = length // 2
        runs = run_hashes(words, half)
        heads, tails = runs[:-half], runs[half:]
        places = np.unique(chosen(mixed(heads + np.uint64(3) * tails), length // 4 + 1))
        places = places[whole[places]]
        yield length, places, heads[places], tails[places]
        length *= 2


def level_of(words: int, wanted: int) -> int:
    """The longest of the lengths wanted, 2 * wanted, 4 * wanted, ... that ``words`` words hold, or 0."""
    return 0 if words < wanted else wanted << (words // wanted).bit_length() - 1


def cut_out(wanted: int):
    """Arrow task over (id, text, places, whole, level, own_*): what is left of every text, and its digest."""
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            lists = batch.column("places")
            limits, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            whole = batch.column("whole").to_numpy(zero_copy_only=False)
            levels = batch.column("level").to_pylist()
            total, gone, digest, left, spans = [], [], [], [], []
            for at, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                # bytes.split() parts at 0x20 and 0x09 to 0x0D, which are the blanks of a word.
                words = raw.split() if raw is not None else []
                own = values[limits[at]:limits[at + 1]]
                all_gone = bool(whole[at]) and len(words) >= wanted
                total.append(len(words))
                if whole[at]:
                    levels[at] = level_of(len(words), wanted)
                if not all_gone and not len(own):
                    gone.append(0)
                    spans.append([])
                    left.append(None if raw is None else raw.decode("utf-8", "replace"))
                    digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    continue
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(cover, own, 1)
                np.add.at(cover, np.minimum(own + wanted, len(words)), -1)
                keep = np.zeros(len(words), dtype=bool) if all_gone else np.cumsum(cover[:-1]) == 0
                gone.append(int(len(keep) - keep.sum()))
                digest.append(hashlib.sha256(b" ".join(compress(words, keep))).hexdigest())
                edges = np.flatnonzero(np.diff(np.concatenate([[False], ~keep, [False]]).astype(np.int8))).reshape(-1, 2)
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in edges])
                left.append(_without(raw, edges))
            own_names = [c for c in batch.schema.names if c.startswith("own_")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(left, pa.string()), pa.array(spans, spans_type), pa.array(levels, pa.int64())]
                + [batch.column(c) for c in own_names],
                ["id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans", "level"] + own_names)

    return task


def _without(raw: bytes, edges: np.ndarray) -> str:
    """The text without words a to b - 1 of every edge, each with the blanks after it."""
    word = byte_class()[np.frombuffer(raw, np.uint8)]
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    out, low = [], 0
    for a, b in edges:
        out.append(raw[low:starts[a]])
        low = starts[b] if b < len(starts) else len(raw)
    out.append(raw[low:])
    return b"".join(out).decode("utf-8", "replace")


def listed_rows(rows: DataFrame, entries: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with ``listed``: whether their (id, tag) may be among those of ``entries``; false is certain.

    A Bloom filter of FILTER_WORDS words, three bits of one word for each entry. Its size is fixed: with very many
    entries more rows are flagged than have one, never fewer.
    """
    word = F.pmod(F.xxhash64("id", "tag"), F.lit(FILTER_WORDS))
    spread = F.xxhash64("tag", "id")
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(spread, 6 * k), F.lit(64)).cast("int"))
            for k in range(3)]
    mask = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])
    words = scratch.cut(entries.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits")), "filter")
    probed = rows.withColumn("word", word).join(F.broadcast(words), "word", "left")
    return probed.withColumn("listed", F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))).drop("word", "bits")


def repeated_windows(docs: DataFrame, chosen_keys: DataFrame, scratch: Scratch, wanted: int, levels: bool = False) -> DataFrame:
    """(id, tag, places, level): where windows of ``wanted`` words begin whose sequence a smaller id has too.

    ``docs`` has (id, tag, text), ``chosen_keys`` the (id, tag, keys) of ``window_choice`` of the texts to compare; a
    text that repeats whole should come once there. The level is that of ``longer_levels``, at least ``wanted``, and
    0 without ``levels``.
    """
    half = wanted // 2
    first = scratch.cut(chosen_keys.select("id", F.explode("keys").alias("key")), "level")
    seen = scratch.cut(first.groupBy("key").agg(
        F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key"), "seen")
    keys = first.join(seen, "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys"))
    keys = scratch.cut(keys.join(chosen_keys.select("id", "tag").distinct(), "id"), "keys")
    scratch.drop(first)
    texts = listed_rows(docs.select("id", "tag", "text"), keys, scratch).where("listed").drop("listed")
    found = texts.join(keys, ["id", "tag"]).dropDuplicates(["id", "tag"]).mapInArrow(
        candidate_windows(half, wanted, levels), "head bigint, tail bigint, id bigint, tag bigint, place int, length int")
    found = scratch.cut(found, "level")
    base = found.where(F.col("length") == wanted).drop("length")
    # Written, so that the join below sees two plain tables and a very common passage can be split.
    lows = scratch.cut(_lowest(base), "lows")
    hits = base.join(lows, ["head", "tail"]).where("id > low")
    places = scratch.cut(hits.groupBy("id", "tag").agg(F.collect_set("place").alias("places")), "places")
    longest = longer_levels(found, scratch, wanted) if levels else None
    scratch.drop(found, lows)
    if longest is None:
        return places.withColumn("level", F.lit(0).cast("bigint"))
    return places.join(longest, ["id", "tag"], "left").withColumn("level", F.coalesce("level", F.lit(wanted)).cast("bigint"))


def _lowest(windows: DataFrame) -> DataFrame:
    return windows.groupBy("head", "tail").agg(
        F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high")


def longer_levels(found: DataFrame, scratch: Scratch, wanted: int) -> DataFrame:
    """(id, tag, level): the longest of the ``longer_windows`` in ``found`` whose sequence a smaller id has too.

    Lengths are doubled until no window repeats, so the number of levels follows the longest repeated passage. A level
    never exceeds the longest passage that a smaller id shares, and a shared passage of 5/4 of a length and more
    reaches that length. No text is read again.
    """
    longer = scratch.cut(found.where(F.col("length") > wanted), "longer")
    alive, done, length = None, [], wanted
    while True:
        length *= 2
        rows = longer.where(F.col("length") == length)
        if alive is not None:
            rows = rows.join(alive, ["id", "tag"]).where(
                f"exists(alive, q -> q between place and place + {length // 2})").select(*longer.columns)
        rows = scratch.cut(rows, "rows")
        hits = rows.join(scratch.cut(_lowest(rows), "lows"), ["head", "tail"])
        state = scratch.cut(hits.groupBy("id", "tag").agg(
            F.collect_set("place").alias("alive"), F.max(F.col("id") > F.col("low")).alias("again")), "alive")
        done.append(state.where("again").select("id", "tag", F.lit(length).alias("level")))
        if state.isEmpty():
            break
        alive = state.select("id", "tag", "alive")
    levels = done[0]
    for more in done[1:]:
        levels = levels.unionByName(more)
    return scratch.cut(levels.groupBy("id", "tag").agg(F.max("level").alias("level")), "levels")


def remove_repeats(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text",
                   wanted: int = 50, levels: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256, kept_text and spans of removed words.

    With ``levels`` also longest_level: how long a repeated passage is, as ``longer_levels`` tells; 0 without one.

    A word goes if a window of ``wanted`` words that covers it also starts in a row with a smaller
    id. Null and empty texts have no words. Rows with a null id stay whole and make no other row lose
    words. Rows that share an id are windows of one document, so neither loses words to the other.
    Other columns pass unchanged; the added names must not be among them.
    """
    own = [c for c in docs.columns if c not in (id, text)]
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"),
                       *[F.col(f"`{c}`").alias(f"own_{c}") for c in own]).withColumn("tag", F.xxhash64("text"))
    # Equal texts are found by a 128-bit digest; only the one with the smallest id goes on.
    named = rows.where("id is not null and length(text) > 0").select(
        "id", "tag", F.expr("unhex(md5(text))").alias("print"), "text")
    named = scratch.cut(named.mapInArrow(
        window_choice(wanted // 2, wanted), "id bigint, tag bigint, print binary, keys array<bigint>"), "choice")
    firsts = scratch.cut(named.groupBy("print").agg(F.min("id").alias("rep")), "prints")
    marked = scratch.cut(named.select("id", "tag", "print").join(firsts, "print").select("id", "tag", "rep").distinct(), "marked")
    alone = named.select("id", "tag", "keys").where("size(keys) > 0").join(marked.where("id = rep"), ["id", "tag"], "left_semi")
    alone = scratch.cut(alone, "alone")
    scratch.drop(named)
    cuts = repeated_windows(rows, alone, scratch, wanted, levels)
    scratch.drop(alone)
    none = F.expr("cast(array() as array<int>)")
    edits = cuts.withColumn("whole", F.lit(False)).unionByName(marked.where("id > rep").select(
        "id", "tag", none.alias("places"), F.lit(0).cast("bigint").alias("level"), F.lit(True).alias("whole")))
    probed = listed_rows(rows, edits, scratch)
    joined = probed.where("listed").join(edits, ["id", "tag"], "left").unionByName(
        probed.where("not listed"), allowMissingColumns=True)
    rows = joined.select(
        "id", "text", F.coalesce("places", none).alias("places"), F.coalesce("whole", F.lit(False)).alias("whole"),
        F.coalesce("level", F.lit(0)).cast("bigint").alias("level"), *[f"`own_{c}`" for c in own])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shape = ("id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, "
             "spans array<struct<first:int,last:int>>, level bigint" + "".join(f", `own_{c}` {kinds[f'own_{c}']}" for c in own))
    done = rows.mapInArrow(cut_out(wanted), shape)
    return done.select(F.col("id").alias(id), *[F.col(f"`own_{c}`").alias(c) for c in own],
                       "n_words", "n_removed", "kept_sha256", "kept_text", "spans",
                       *[F.col("level").alias("longest_level")] * levels)
