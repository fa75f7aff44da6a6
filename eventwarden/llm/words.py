"""Words and word-sequence hashes of whole texts, for all rows of an Arrow batch at once.

A text is its UTF-8 bytes. Words are found by byte class and hashed with differences of running
sums, so nothing here loops over words in Python. Work goes through slices of rows of about
``SLICE`` bytes; a longer text is a slice of its own and is hashed in pieces cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Kept small: arrays of a slice are a multiple of it, and a worker keeps room for the largest it has had.
SLICE = 1 << 20
PIECE = 1 << 18

#: Bytes that end a word: 0x20 and 0x09 to 0x0D.
BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)


def byte_class(extra: bool = False) -> np.ndarray:
    """256 flags: True for bytes inside words; ``extra`` also ends words at ASCII punctuation."""
    inside = np.ones(256, dtype=bool)
    inside[list(BLANKS)] = False
    if extra:
        keep = np.zeros(256, dtype=bool)
        keep[128:] = True
        for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
            keep[ord(first):ord(last) + 1] = True
        inside &= keep
    return inside


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    return table


class Constants(NamedTuple):
    """Random odd multipliers; the same in every task because the seed is fixed."""

    letters: np.ndarray
    powers: np.ndarray
    inverses: np.ndarray
    places: np.ndarray


def constants(size: int) -> Constants:
    """Tables for pieces of up to ``size`` bytes; kept in the worker between tasks."""
    import sys
    import types

    store = sys.modules.setdefault("_word_tables", types.ModuleType("_word_tables"))
    known = getattr(store, "tables", None)
    if known is not None and len(known.powers) > size:
        return known
    length = 1 << max(PIECE.bit_length(), int(size + 1).bit_length())
    rng = np.random.default_rng(20240501)
    letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    steps = np.full(length, base, dtype=np.uint64)
    steps[0] = 1
    back = np.full(length, pow(base, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    places = rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    store.tables = Constants(letters, np.multiply.accumulate(steps), np.multiply.accumulate(back), places)
    return store.tables


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release() -> None:
    """Give back what Arrow holds in reserve: a worker lives on, and its next task may be of another kind."""
    pa.default_memory_pool().release_unused()


class Words(NamedTuple):
    """Words of consecutive rows. ``first[r]:first[r + 1]`` are the words of row r."""

    rows: slice
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray | None


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row limits of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    limits = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data, limits


def slices(limits: np.ndarray) -> Iterator[slice]:
    """Consecutive rows of about SLICE bytes."""
    low, count = 0, len(limits) - 1
    while low < count:
        high = int(np.searchsorted(limits, limits[low] + SLICE, "right")) - 1
        high = min(max(high, low + 1), count)
        yield slice(low, high)
        low = high


def words_of(column: pa.Array, lower: bool = False, hashed: bool = True,
             inside: np.ndarray | None = None) -> Iterator[Words]:
    """Words of a batch, slice by slice; starts and ends are places in ``data``."""
    inside = byte_class() if inside is None else inside
    data, limits = texts(column)
    for rows in slices(limits):
        begin, end = int(limits[rows.start]), int(limits[rows.stop])
        part = data[begin:end]
        if lower:
            part = lower_table()[part]
        cuts = limits[rows.start:rows.stop + 1] - begin
        word = inside[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[cuts] = True
        before = np.empty(len(part), dtype=bool)
        if len(part):
            before[0] = False
            before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.zeros(len(part), dtype=bool)
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        first = np.searchsorted(starts, cuts)
        yield Words(rows, part, starts, ends, first, word_hashes(part, starts, ends) if hashed else None)
    release()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + PIECE, "right")))
        begin, end = int(starts[low]), int(ends[high - 1])
        tables = constants(end - begin)
        sums = np.empty(end - begin + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(tables.letters[data[begin:end]] * tables.powers[:end - begin], out=sums[1:])
        s, e = starts[low:high] - begin, ends[low:high] - begin
        out[low:high] = mixed((sums[e] - sums[s]) * tables.inverses[s] + (e - s).astype(np.uint64))
        low = high
    return out


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words, rows ignored."""
    if len(hashes) < length:
        return np.zeros(0, dtype=np.uint64)
    if length <= 16:
        places = constants(0).places
        total = hashes[:len(hashes) - length + 1] * places[0]
        for k in range(1, length):
            total = total + hashes[k:len(hashes) - length + 1 + k] * places[k]
        return mixed(total + np.uint64(length))
    tables = constants(len(hashes))
    sums = np.empty(len(hashes) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(hashes * tables.powers[:len(hashes)], out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * tables.inverses[:len(hashes) - length + 1] + np.uint64(length))


def shingles(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words inside rows, and row limits in them.

    A row with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    counts = np.diff(found.first)
    runs = run_hashes(found.hashes, length)
    sizes = np.where(counts >= length, counts - length + 1, (counts > 0).astype(counts.dtype))
    limits = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(limits[-1], dtype=np.uint64)
    full = np.flatnonzero(counts >= length)
    if len(full):
        places = np.repeat(found.first[full] - limits[full], sizes[full])
        spots = np.repeat(counts >= length, sizes)
        index = np.flatnonzero(spots)
        out[index] = runs[index + places]
    for row in np.flatnonzero((counts > 0) & (counts < length)):
        piece = found.hashes[found.first[row]:found.first[row + 1]]
        out[limits[row]] = run_hashes(piece, len(piece))[0]
    return out, limits
