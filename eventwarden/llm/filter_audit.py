"""How document filters interact: what each one removes in every order of application.

* A task measures its whole texts and inserts them into a compressed trie of its own, whose terminals hold
  the smallest id. A row with a larger id than its terminal is a duplicate already; the others, one per text,
  task and part, travel on with their text. So a text with very many copies is sent once per task.
* Texts are dealt to ranges between adaptive prefixes: the shortest prefixes that tell apart neighbouring
  texts of a bounded sample. The sample decides how even the ranges are, never a result.
* Each range inserts its texts into one trie; a row is a duplicate if its terminal holds a smaller id.
* A document becomes a mask of the filters it fails. Masks are counted per part, and everything about all
  orders follows from those counts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from itertools import permutations
from math import ceil, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.text_trie import Trie

#: Failure conditions over the measures of a text, in the order of their letters.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 3 * n_chars",
    "D": "has_sign",
    "E": "is_copy",
}
#: Bytes of text after which a task starts a new trie; bounds its memory, not its result.
HELD_BYTES = 32 << 20
#: Text bytes wanted per range, sampled texts per range, and sampled texts at most.
RANGE_BYTES = 64 << 20
PER_RANGE = 20
SAMPLED = 100_000
#: Bytes of all prefixes together that are sent to the tasks at most; above it, ranges are joined in pairs.
PREFIX_BYTES = 16 << 20

UPPER = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = rb"[#$%&*|]"
MEASURES = "n_words bigint, n_distinct bigint, n_upper bigint, n_chars bigint, has_sign boolean"
MEASURE_TYPES = [pa.int64()] * 4 + [pa.bool_()]
MEASURE_NAMES = ["n_words", "n_distinct", "n_upper", "n_chars", "has_sign"]


def prefixes_of(wanted: int | None, rows: int, least: int):
    """Arrow task over sampled texts: (prefixes), the shortest that part the sample into equal ranges."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, texts, held = Trie(), 0, 0
        for batch in batches:
            for raw in batch.column("text").to_pylist():
                trie.insert(raw, 0)
                texts, held = texts + 1, held + len(raw)
        if not texts:
            return
        count = wanted or max(least, ceil(rows * (held / texts) / RANGE_BYTES))
        found = [text[:shared + 1] for text, _, shared in trie.ordered()]
        places = sorted({len(found) * k // count for k in range(1, count)} - {0})
        bounds = [found[k] for k in places]
        while sum(map(len, bounds)) > PREFIX_BYTES:
            bounds = bounds[::2] if len(bounds) > 1 else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([bounds], pa.list_(pa.binary())), pa.array([count], pa.int64())], ["prefixes", "wanted"])

    return task


def adaptive_prefixes(texts: DataFrame) -> list[bytes]:
    """Ascending prefixes between which lie about equally many of the texts (one binary column ``text``)."""
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, wanted = texts.count(), None
    if not rows:
        return []
    while True:
        share = min(1.0, min(PER_RANGE * (wanted or least), SAMPLED) / rows)
        sample = texts.sample(share, seed=11).repartition(1)
        listed = sample.mapInArrow(prefixes_of(wanted, rows, least), "prefixes array<binary>, wanted bigint").collect()
        if not listed or wanted or listed[0]["wanted"] <= least:
            return [bytes(p) for p in listed[0]["prefixes"]] if listed else []
        wanted = min(listed[0]["wanted"], SAMPLED // 2)


def measured_rows(bounds: list[bytes]):
    """Arrow task over (id, part, text): measures; rows not yet known to be copies keep their text and range."""
    names = ["id", "part", "copies", *MEASURE_NAMES, "is_copy", "text", "range"]
    kinds = [pa.int64(), pa.string(), pa.int64(), *MEASURE_TYPES, pa.bool_(), pa.binary(), pa.int32()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = re.compile(SIGNS).search

        def measure(raw: bytes) -> tuple:
            # bytes.split() parts at 0x20 and 0x09 to 0x0D, the blanks of a word.
            words = raw.split()
            return (len(words), len(set(words)), len(raw) - len(raw.translate(None, UPPER)),
                    len(raw.decode("utf-8", "replace")), sign(raw) is not None)

        def told(trie: Trie, known: dict, rows: list) -> Iterator[pa.RecordBatch]:
            first: dict[tuple, int] = {}
            copies: list[int] = []
            out: list[tuple] = []
            for id, part, node in rows:
                if id is not None and id == trie.least[node]:
                    # One row for the smallest id of a text; equal rows are counted.
                    spot = first.setdefault((node, part), len(out))
                    if spot < len(out):
                        copies[spot] += 1
                        continue
                    raw, facts = known[node]
                    out.append((id, part, *facts, None, raw, bisect_right(bounds, raw)))
                else:
                    out.append((id, part, *known[node][1], id is not None, None,
                                (0 if id is None else id) % (len(bounds) + 1)))
                copies.append(1)
            for low in range(0, len(out), 4096):
                columns = list(zip(*out[low:low + 4096], strict=True))
                columns.insert(2, copies[low:low + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        trie, known, rows, held = Trie(), {}, [], 0
        for batch in batches:
            ids, parts = batch.column("id").to_pylist(), batch.column("part").to_pylist()
            for id, part, raw in zip(ids, parts, batch.column("text").to_pylist(), strict=True):
                if id is None:
                    # No id is smaller or larger than a null one: never a copy, and makes no other a copy.
                    node = -1 - len(rows)
                    known[node] = (b"", measure(raw))
                    rows.append((None, part, node))
                else:
                    node = trie.insert(raw, id)
                    if node not in known:
                        known[node] = (raw, measure(raw))
                        held += len(raw)
                    rows.append((id, part, node))
                if held > HELD_BYTES or len(rows) >= 200_000:
                    yield from told(trie, known, rows)
                    trie, known, rows, held = Trie(), {}, [], 0
        yield from told(trie, known, rows)

    shape = f"id bigint, part string, copies bigint, {MEASURES}, is_copy boolean, text binary, range int"
    return task, shape


def settled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task over one range: whether the rows that still have a text are copies."""
    trie, waiting = Trie(), []
    for batch in batches:
        plain = batch.drop_columns(["text", "range"])
        texts = batch.column("text")
        open_rows = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        if not len(open_rows):
            yield plain
            continue
        own = texts.take(pa.array(open_rows)).to_pylist()
        ids = batch.column("id").take(pa.array(open_rows)).to_pylist()
        nodes = [trie.insert(raw, id) for raw, id in zip(own, ids, strict=True)]
        waiting.append((plain, open_rows, ids, nodes))
    spot = 3 + len(MEASURE_NAMES)
    for plain, open_rows, ids, nodes in waiting:
        flags = plain.column("is_copy").fill_null(False).to_numpy(zero_copy_only=False).copy()
        flags[open_rows] = [trie.least[n] < id for n, id in zip(nodes, ids, strict=True)]
        yield plain.set_column(spot, "is_copy", pa.array(flags))


def judged(docs: DataFrame, filters: Mapping[str, str] = FILTERS, id: str = "doc_id", text: str = "text",
           part: str = "lang") -> DataFrame:
    """(id, part, mask, copies): the filters every document fails, bit k for the k-th filter.

    Null texts are empty, a null part is the empty string. Equal rows under one id may come as one row with
    their number in ``copies``. A row with a null id is never a copy of another. Other columns are not read.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    bounds = adaptive_prefixes(rows.select("text"))
    task, shape = measured_rows(bounds)
    dealt = rows.mapInArrow(task, shape).repartitionById(len(bounds) + 1, "range")
    done = dealt.mapInArrow(settled_rows, f"id bigint, part string, copies bigint, {MEASURES}, is_copy boolean")
    mask = F.lit(0)
    for place, condition in enumerate(filters.values()):
        mask = mask + F.when(F.expr(condition), 1 << place).otherwise(0)
    return done.select("id", "part", mask.alias("mask"), "copies")


def label_counts(masks: DataFrame, labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and mask, and how many of them are labelled so.

    A document is good or toxic if any label row of its id says 1; null labels say nothing.
    """
    said = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).cast("bigint").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = masks.groupBy("id", "part", "mask").agg(F.sum("copies").alias("n")).join(said, "id", "left")
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS, id: str = "doc_id",
          text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; see ``judged`` for nulls and repeated rows.

    kept: left after the step; removed: by this step; redundant: fail its filter but went earlier;
    unique_fails: fail no other filter; good_lost, toxic_lost: removed here with such a label; shapley: what
    the step's filter removes, summed over all orders. An empty table has no part and so no row.
    """
    letters = "".join(filters)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    bits = F.create_map(*[F.lit(x) for k, c in enumerate(letters) for x in (c, 1 << k)])
    counts = label_counts(judged(docs, filters, id, text, part), labels, id)
    # A part has at most one group per mask.
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("groups"))
    steps = (
        per_part.select("part", "groups", F.explode(orders).alias("filter_order"))
        .select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))
        .where("letter <> ''")
        .withColumns({
            "step": (F.col("place") + 1).cast("int"), "bit": bits[F.col("letter")],
            "before": F.aggregate(F.split(F.expr("substr(filter_order, 1, place)"), ""), F.lit(0),
                                  lambda sum_, c: sum_ + F.coalesce(bits[c], F.lit(0)))})
    )
    bit, before = F.col("bit"), F.col("before")

    def total(which, value):
        return F.aggregate("groups", F.lit(0).cast("bigint"), lambda sum_, g: sum_ + F.when(which(g["mask"]), value(g)).otherwise(0))

    def fails(mask):
        return mask.bitwiseAND(bit) != 0

    def here(mask):
        return fails(mask) & (mask.bitwiseAND(before) == 0)

    def n(group):
        return group["n"]

    share = F.lit(factorial(len(letters)))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: m.bitwiseAND(before + bit) == 0, n).alias("kept"),
        total(here, n).alias("removed"),
        total(lambda m: fails(m) & (m.bitwiseAND(before) != 0), n).alias("redundant"),
        total(lambda m: m == bit, n).alias("unique_fails"),
        total(here, lambda g: g["good"]).alias("good_lost"),
        total(here, lambda g: g["toxic"]).alias("toxic_lost"),
        # Of all orders, the filter comes first among the s filters a document fails in one of s.
        total(fails, lambda g: (n(g) * (share / F.bit_count(g["mask"])).cast("bigint"))).alias("shapley"))
