"""Conversations as training text, assembled as bytes, and read back.

Every turn stands between the marks of its role. Marks inside texts are escaped: a backslash goes behind
the first sign of a mark, one more than stand there already, so reading takes one away and nothing is lost.
The loss mask is a list of spans over the formatted text, one for every assistant text.

A slice of turns is formatted at once: numpy finds the length of every header, text and footer, their
offsets by running sums, and for every byte its place in one buffer, which becomes the Arrow column as it is.

Rows are dealt by conversation and turn in ranges, so a conversation of any length is spread over tasks. It
comes out as one or more parts in order; most have one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.words import slices, texts

#: Header and footer of each role; any other role is named between ROLE marks.
MARKS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": (" ", " </s>"),
}
OTHER = ("[ROLE]", "[/ROLE] ", " [/TURN]")
#: What a mark is without its first sign; none of them holds a whole mark.
AFTER = {"<": ("s>", "/s>", "<SYS>>", "</SYS>>"), "[": ("INST]", "/INST]", "ROLE]", "/ROLE]", "/TURN]")}
#: The role whose texts are learned.
LEARNED = "assistant"


def marks(backslashes: str) -> str:
    """Pattern of a mark's first sign with backslashes behind it; the rest of the mark is a group looked ahead at."""
    return "|".join(f"{re.escape(first)}{backslashes}(?=({'|'.join(map(re.escape, rest))}))" for first, rest in AFTER.items())


ESCAPE, UNESCAPE = marks(r"\\*"), marks(r"\\+")
PARTS = "conv_id bigint, part bigint, n_turns bigint, formatted string, learned array<struct<begin:int,end:int>>"


def escaped(text: str) -> str:
    return re.sub(ESCAPE, lambda m: m.group(0) + "\\", text)


def unescaped(text: str) -> str:
    return re.sub(UNESCAPE, lambda m: m.group(0)[:-1], text)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] places, then the same of the next."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def backslashes(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Places in ``data`` in front of which a backslash goes; marks across row limits are none."""
    raw = data.tobytes()
    found = [(m.start(), m.end(), m.end(m.lastindex)) for m in re.finditer(ESCAPE.encode(), raw)]
    if not found:
        return np.zeros(0, np.int64)
    begins, spots, ends = np.array(found, dtype=np.int64).T
    return spots[ends <= limits[np.searchsorted(limits, begins, "right")]]


def assemble(roles: list[str], data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of turns, where each turn begins in them, and where its text begins and ends.

    ``limits`` are the places in ``data`` where texts begin and end, from 0.
    """
    names = sorted(set(roles))
    number = {role: n for n, role in enumerate(names)}
    code = np.array([number[r] for r in roles], dtype=np.int64)
    around = [MARKS.get(r) or (OTHER[0] + escaped(r) + OTHER[1], OTHER[2]) for r in names]
    extra = backslashes(data, limits)
    before = np.searchsorted(extra, limits)
    sizes = np.diff(limits)
    content = sizes + np.diff(before)
    heads, foots = ([m[k].encode() for m in around] for k in (0, 1))
    lengths = [np.array([len(x) for x in group], dtype=np.int64) for group in (heads, foots)]
    total = lengths[0][code] + content + lengths[1][code]
    begins = np.concatenate([[0], np.cumsum(total)])
    first = begins[:-1] + lengths[0][code]
    out = np.empty(begins[-1], dtype=np.uint8)
    # A text moves as a whole, and each byte by the backslashes in front of it in its row.
    moved = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(moved, extra, 1)
    places = spread(first, sizes) + np.cumsum(moved[:-1]) - np.repeat(before[:-1], sizes)
    out[places] = data
    out[places[extra] - 1] = ord("\\")
    for group, length, at in ((heads, lengths[0], begins[:-1]), (foots, lengths[1], first + content)):
        table = np.frombuffer(b"".join(group), dtype=np.uint8)
        starts = np.cumsum(length) - length
        out[spread(at, length[code])] = table[spread(starts[code], length[code])]
    return out, begins, np.stack([first, first + content])


def format_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task over (conv_id, role, text, place), sorted: one row per conversation and slice."""
    number = 0
    for batch in batches:
        if not len(batch):
            continue
        data, limits = texts(batch.column("text"))
        ids, roles = batch.column("conv_id"), batch.column("role").to_pylist()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy()
        place = batch.column("place")[0].as_py()
        for rows in slices(limits):
            own = limits[rows.start:rows.stop + 1]
            out, begins, span = assemble(roles[rows], data[own[0]:own[-1]], own - own[0])
            v, k = values[rows], known[rows]
            changes = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (k[1:] != k[:-1])]))
            cuts = np.append(changes, len(v))
            offsets = begins[cuts]
            # Spans are in code points: count the bytes that begin one.
            points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            learned = np.flatnonzero(np.array([r == LEARNED for r in roles[rows]]))
            base = points[np.repeat(offsets[:-1], np.diff(cuts))][learned]
            spans = pa.StructArray.from_arrays(
                [pa.array((points[edge[learned]] - base).astype(np.int32)) for edge in span], ["begin", "end"])
            formatted = pa.Array.from_buffers(
                pa.string(), len(changes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(rows.start, len(v)).take(pa.array(changes)),
                 pa.array((place << 32) + number + np.arange(len(changes))), pa.array(np.diff(cuts)), formatted,
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(learned, cuts).astype(np.int32)), spans)],
                ["conv_id", "part", "n_turns", "formatted", "learned"])
            number += len(changes)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, formatted, learned) of all conversations, turns in ascending order.

    A null text or role is empty; a null turn comes first, and equal turns in the order of role and text;
    repeated rows are repeated turns; rows with a null conversation are one conversation. ``learned`` are the
    spans under the loss mask in code points of ``formatted``. Other columns are not read. An empty table
    gives no row. Parts of a conversation follow each other by ``part``.
    """
    rows = turns.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)]
    count = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, *order).sortWithinPartitions(*order, "text")
    return dealt.select("conv_id", "role", "text", F.spark_partition_id().alias("place")).mapInArrow(format_turns, PARTS)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted part."""
    at = 0
    while at < len(formatted):
        if formatted.startswith(OTHER[0], at):
            end = formatted.index(OTHER[1], at)
            role, head, foot = unescaped(formatted[at + len(OTHER[0]):end]), end + len(OTHER[1]) - at, OTHER[2]
        else:
            role = next(r for r, (mark, _) in MARKS.items() if formatted.startswith(mark, at))
            head, foot = len(MARKS[role][0]), MARKS[role][1]
        end = formatted.index(foot, at + head)
        yield role, unescaped(formatted[at + head:end])
        at = end + len(foot)


def digest_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task over parts sorted by conversation and part: one row per conversation, parsed on the way."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def told(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names)

    key, done = (), []
    turns = loss = hashlib.sha256()
    n_turns = loss_chars = chars = 0
    for batch in batches:
        for conv, formatted, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(),
                                          batch.column("learned").to_pylist(), strict=True):
            if key != (conv,):
                if key:
                    done.append((*key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                key, turns, loss = (conv,), hashlib.sha256(), hashlib.sha256()
                n_turns = loss_chars = chars = 0
            for role, text in read_turns(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n_turns += 1
            for span in spans:
                text = unescaped(formatted[span["begin"]:span["end"]])
                loss.update(text.encode())
                loss_chars += len(text)
            chars += len(formatted)
        if len(done) >= 4096:
            yield told(done)
            done = []
    if key:
        done.append((*key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        yield told(done)


def digests(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from ``format_chats``.

    A conversation is hashed from its few parts, one after another; its turns are not gathered.
    """
    rows = parts.select("conv_id", "part", "formatted", "learned").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(digest_parts, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                         "loss_sha256 string, formatted_chars bigint")


def turns_of(parts: DataFrame) -> DataFrame:
    """(conv_id, part, place, role, text) of every turn, parsed from ``format_chats``; places count from 0 in a part."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, formatted in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "formatted")), strict=True):
                found = list(read_turns(formatted))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(found), pa.int64()), pa.array([part] * len(found), pa.int64()),
                     pa.array(range(len(found)), pa.int64()), pa.array([r for r, _ in found], pa.string()),
                     pa.array([t for _, t in found], pa.string())], ["conv_id", "part", "place", "role", "text"])

    return parts.mapInArrow(task, "conv_id bigint, part bigint, place bigint, role string, text string")
