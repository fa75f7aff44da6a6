"""Byte-level BPE: encoding by rank arrays, and decoding.

A text is cut into pieces by the pattern of the vocabulary. For every short piece the parts and the ranks of
adjacent parts stand in two rows of arrays; again and again the smallest rank is found, the boundary there is
deleted, and the ranks on both sides are looked up anew. All pieces of a batch that are new do this side
by side, one array row each. Long pieces use the same rule with a heap and a linked list, so a piece of any
length costs no more than its length times its logarithm.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.words import release

#: Fixed value: the piece pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to which a piece is short; pieces a task remembers before it starts over.
SHORT = 24
REMEMBERED = 100_000
NEVER = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if chr(b) not in letters]
    return letters | {chr(256 + n): b for n, b in enumerate(others)}


class Vocabulary:
    """Merge ranks, merged ids and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, number in ids.items():
            self.bytes[number] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        for token, number in self.special.items():
            self.bytes[number] = token.encode()
        self.decimal = [b"%d," % n for n in range(size)]
        self.single = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks, self.made = keys[order], order.astype(np.int32), made
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of adjacent parts; NEVER where they do not merge or a part is missing (-1)."""
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
        near = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[near] == wanted) & (right >= 0) & (left >= 0), self.key_ranks[near], NEVER)

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short pieces, all at once, as the bytes of 32-bit numbers."""
        count = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max()) + 1
        inside = np.arange(width) < sizes[:, None]
        parts = np.full((count, width), -1, dtype=np.int32)
        parts[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((count, width), NEVER, dtype=np.int32)
        ranks[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
        rows = np.arange(count)
        columns = np.arange(width)
        done = parts.copy()
        while len(rows):
            at = ranks.argmin(axis=1)
            here = np.arange(len(rows))
            least = ranks[here, at]
            busy = least < NEVER
            if not busy.all():
                done[rows[~busy]] = parts[~busy]
                rows, parts, ranks, at, least = rows[busy], parts[busy], ranks[busy], at[busy], least[busy]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            # Delete the boundary: everything behind the merged part moves one place left.
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, source, 1)
            parts[:, -1] = -1
            parts[here, at] = self.made[least]
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[:, -1] = NEVER
            ranks[here, at] = self.ranks(parts[here, at], parts[here, at + 1])
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.ranks(parts[some, at[some] - 1], parts[some, at[some]])
        left = done >= 0
        cuts = np.concatenate([[0], 4 * np.cumsum(left.sum(axis=1))]).tolist()
        raw = done[left].tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one piece of any length, as the bytes of 32-bit numbers."""
        parts = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        ranks, made, last = self.rank_of, self.made, len(parts)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= last or parts[j] != b:
                continue
            parts[i] = int(made[rank])
            parts[j] = -1
            after[i] = after[j]
            if after[i] < last:
                before[after[i]] = i
                if (r := ranks.get(parts[i] << 32 | parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (r := ranks.get(parts[before[i]] << 32 | parts[i])) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
        return np.array([p for p in parts if p >= 0], dtype=np.int32).tobytes()


class Encoder:
    """Encodes texts; remembers the ids of stretches between blanks."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.blank_before_space = re.compile(r"\s ")
        self.cut = re.compile(r"(?<=\S)(?= )")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        self.marks = tuple(self.vocabulary.special)
        self.pieces: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def _stretches(self, text: str) -> list[str]:
        """Cut in front of every space that follows a non-blank: no piece of the pattern goes across."""
        if not text:
            return []
        if self.blank_before_space.search(text):
            return self.cut.split(text)
        first, *others = text.split(" ")
        found = [" " + x for x in others]
        return [first, *found] if first else found

    def _learn(self, fresh: list[str]) -> None:
        find = self.pattern.findall
        # A space and letters, or letters alone, are one piece.
        cut = [(s,) if s[1:].isalpha() and (s[0] == " " or s[0].isalpha()) else find(s) for s in fresh]
        raw = {p: p.encode() for p in set(chain.from_iterable(cut)).difference(self.pieces)}
        by_size: dict[int, list[str]] = {}
        for p, b in raw.items():
            by_size.setdefault(min(-(-len(b) // 4), SHORT // 4 + 1), []).append(p)
        for size, own in by_size.items():
            if size > SHORT // 4:
                self.pieces.update((p, self.vocabulary.merge_long(raw[p])) for p in own)
                continue
            for low in range(0, len(own), 8192):
                part = own[low:low + 8192]
                self.pieces.update(zip(part, self.vocabulary.merge_short([raw[p] for p in part]), strict=True))
        known = self.pieces
        self.stretches.update(
            (s, known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces]))
            for s, pieces in zip(fresh, cut, strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; special tokens in a text are recognised, as the library does by default."""
        if len(self.stretches) > REMEMBERED or len(self.pieces) > REMEMBERED:
            self.stretches, self.pieces = {}, {}
        cut: list[list[str]] = []
        for text in texts:
            if not any(m in text for m in self.marks):
                cut.append(self._stretches(text))
                continue
            own: list[str] = []
            for n, part in enumerate(self.specials.split(text)):
                own += self._stretches(part) if n % 2 == 0 else [part]
            cut.append(own)
        for mark, number in self.vocabulary.special.items():
            self.stretches[mark] = np.int32(number).tobytes()
        fresh = set().union(*cut).difference(self.stretches)
        if fresh:
            self._learn(list(fresh))
        known = self.stretches.__getitem__
        return [np.frombuffer(b"".join(map(known, own)), np.int32) for own in cut]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a list of ids, special tokens included; invalid UTF-8 is replaced."""
        raw = b"".join(map(self.vocabulary.bytes.__getitem__, ids))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary, kept in the worker between tasks."""
    import sys
    import types

    store = sys.modules.setdefault("_byte_bpe", types.ModuleType("_byte_bpe"))
    if getattr(store, "path", None) != path:
        store.encoder, store.path = Encoder(path), path
    return store.encoder


def _texts(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") for b in column.cast(pa.binary()).fill_null(b"").to_pylist()]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids. Null and empty texts have none. The name must be new."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                found = pa.array(own.encode(_texts(part.column(text))), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, ids])

    return docs.mapInArrow(task, _shape(docs, f"`{ids}` array<int>"))


def decode(rows: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of a column of token ids. Null and empty lists give an empty text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            found = [own.decode(x or []).decode() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, text])

    return rows.mapInArrow(task, _shape(rows, f"`{text}` string"))


def round_trip(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, token_ids]): texts encoded and their ids decoded in one pass.

    ids_sha256 is of the decimal ids joined by commas; decoded_sha256 of the decoded text in UTF-8.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        decimal = own.vocabulary.decimal
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                found = own.encode(_texts(part.column("text")))
                lists = [ids.tolist() for ids in found]
                listed = [hashlib.sha256(b"".join(map(decimal.__getitem__, ids))[:-1]).hexdigest() for ids in lists]
                back = [hashlib.sha256(own.decode(ids)).hexdigest() for ids in lists]
                columns = [part.column("id"), pa.array([len(ids) for ids in found], pa.int64()), pa.array(listed), pa.array(back)]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(found, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        release()

    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else "")
    return rows.mapInArrow(task, shape).withColumnRenamed("id", id)


def _shape(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [more])
