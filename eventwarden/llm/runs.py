"""Stretches of words that repeat with a period inside one document.

A run is a stretch in which words a period apart are equal, that no neighbouring word extends. Every run has
a Lyndon root: a word of one period that is smaller than its proper suffixes, in the order of the letters or
in the reverse order. So the longest Lyndon words at all places, in both orders, are candidates; each is
extended in both directions by longest common extensions from suffix trees of the text and of its reversal.

A word of a run with k whole periods occurs in it k times. Words that are rarer in their stretch of words
are in no run; the text is cut there, again and again, and what is left goes into the trees. This loses no
run, and prose without repetitions leaves very little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.suffix_tree import Extensions, SuffixTree, next_smaller
from eventwarden.llm.words import Words, words_of

#: Words of one tree, unless a single stretch is longer.
TREE_WORDS = 1 << 14
COUNTERS = 1 << 21


def repeats_in(letters: list[int], least_length: int, exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    count = len(letters)
    backward = Extensions(*SuffixTree(letters[::-1]).tour()[:2])
    tree = SuffixTree(letters)
    depths, places, ordered = tree.tour()
    forward = Extensions(depths, places)
    found = [np.zeros((0, 3), dtype=np.int64)]
    here = np.arange(count)
    for order in (ordered, tree.downwards()):
        # From i to its next smaller suffix j: the root. Both ends are extended as far as words agree.
        j = next_smaller(order)
        period = j - here
        right = forward.common(here, j)
        # Place p of the text is place count - 1 - p of the reversal, so what lies left of i begins there at count - i.
        left = backward.common(count - here, count - j)
        length = left + period + right
        good = length >= np.maximum(least_length, exponent * period)
        found.append(np.stack([here - left, length, period], axis=1)[good])
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def promising(found: Words, least_length: int, exponent: int) -> np.ndarray:
    """Rows (first word, words) of the stretches that can hold a run; a stretch never crosses a row."""
    counts = np.diff(found.first)
    where = np.arange(len(found.starts))
    stretch = np.repeat(np.arange(len(counts)), counts)
    while len(where):
        # Counted by a hash of stretch and word: words that share a counter only look more frequent.
        key = (found.hashes[where] ^ (stretch.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        slot = (key >> np.uint64(43)).astype(np.int64)
        keep = np.bincount(slot, minlength=COUNTERS)[slot] >= exponent
        left, own = where[keep], stretch[keep]
        new = np.cumsum(np.concatenate([[1], (np.diff(left) > 1) | (np.diff(own) > 0)])) if len(left) else left
        long = np.bincount(new)[new] >= least_length if len(left) else np.zeros(0, bool)
        before, where, stretch = len(where), left[long], new[long]
        if len(where) > 0.9 * before:
            break
    if not len(where):
        return np.zeros((0, 2), dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(stretch) > 0]))
    return np.stack([where[first], np.diff(np.append(first, len(where)))], axis=1)


def runs_of(found: Words, least_length: int, exponent: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each row of a slice that has any: its runs as (start, length, period), by start, then period."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    stretches = promising(found, least_length, exponent)
    data, starts, ends = found.data, found.starts, found.ends
    low = 0
    while low < len(stretches):
        ends_at = np.cumsum(stretches[low:, 1])
        high = low + max(1, int(np.searchsorted(ends_at, TREE_WORDS, "right")))
        own = stretches[low:high]
        number: dict[bytes, int] = {}
        letters: list[int] = []
        begins = []
        for first, size in own.tolist():
            begins.append(len(letters))
            base = int(starts[first])
            raw = data[base:int(ends[first + size - 1])].tobytes()
            spots = zip((starts[first:first + size] - base).tolist(), (ends[first:first + size] - base).tolist(), strict=True)
            letters += [number.setdefault(raw[a:b], len(number) + 1) for a, b in spots]
            # A letter of its own between two stretches, so that no run goes across.
            letters.append(-1)
        letters.pop()
        gaps = [b - 1 for b in begins[1:]]
        for n, gap in enumerate(gaps):
            letters[gap] = len(number) + 1 + n
        runs = repeats_in(letters, least_length, exponent)
        which = np.searchsorted(begins, runs[:, 0], "right") - 1
        at = own[which, 0] + runs[:, 0] - np.array(begins)[which]
        rows = np.searchsorted(found.first, at, "right") - 1
        for row, start, length, period in zip(rows.tolist(), (at - found.first[rows]).tolist(),
                                              runs[:, 1].tolist(), runs[:, 2].tolist(), strict=True):
            out.setdefault(row, []).append((start, length, period))
        low = high
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run contains after its first period."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = 6, exponent: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs by start, then period, and its text without them.

    A run has at least ``least_length`` words and ``exponent`` periods, its smallest period counts, and its
    places are word numbers from 0. ``collapsed`` holds the words that no run contains after its first
    period, joined by one space. Null and empty texts have no words, no runs and an empty ``collapsed``;
    repeated rows and rows with a null id come back as they are; other columns are not read.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in words_of(batch.column("text")):
                count = found.rows.stop - found.rows.start
                part = batch.slice(found.rows.start, count)
                runs = runs_of(found, least_length, exponent)
                kept = []
                for row, raw in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    # bytes.split() parts at 0x20 and 0x09 to 0x0D, the blanks of a word.
                    words = raw.split() if raw else []
                    kept.append(collapsed(words, runs[row]) if row in runs else b" ".join(words))
                listed = [[{"start": a, "length": b, "period": c} for a, b, c in runs.get(row, ())] for row in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(found.first).astype(np.int64)), pa.array(listed, RUNS),
                     pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(task, shape).withColumnRenamed("id", id)
