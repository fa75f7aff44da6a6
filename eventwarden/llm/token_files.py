"""Token ids as flat binary files with document offsets, written and read by many tasks.

One shard is three files: ``*.ids`` holds the ids of its documents one after another as little-endian
unsigned integers of 2 or 4 bytes; ``*.offsets`` holds, per document, where its ids end as a 64-bit count,
after a leading zero; ``*.docs`` holds the 64-bit document ids, the smallest number for null. Shards follow each other in ascending id order. A manifest row per shard names the
files and their counts; a shard's base, the number of ids before it, is a prefix sum over the manifest.

A task writes under a name of its own attempt and only then reports it, so the manifest, written as one
table, lists whole files of successful attempts even if executors are lost.
"""

from __future__ import annotations

import os
import sys
import types
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventwarden.llm.scratch import Scratch, open_store

MANIFEST = "shard int, name string, n_docs bigint, n_tokens bigint, width int"
NO_ID = -(1 << 63)
#: Pieces whose ids a task remembers before it starts over; bounds its memory, not its result.
REMEMBERED = 1_000_000
#: Punctuation that the tokenizer parts from a word in front of it.
TAIL = b".,;:!?*%&$#|)"


class PieceEncoder:
    """Ids of blank-separated pieces, from the tokenizers library, each word asked for once.

    The tokenizer drops white space and splits at it, so a text's ids are its pieces' ids in order.
    Pieces are cut at ASCII blanks only; other white space stays inside a piece for the library. A word is
    also cut from ASCII punctuation behind it, where the tokenizer always splits, and its letter case does
    not matter to the tokenizer.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype(f"<u{width}")
        self.pieces: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {b"": b""}

    def _ask(self, parts: list[bytes]) -> None:
        """Ids of parts without blanks: many in one call, told apart by where their tokens lie."""
        for low in range(0, len(parts), 256):
            own = [p.decode("utf-8", "replace") for p in parts[low:low + 256]]
            found = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.kind)
            begins = np.array([a for a, _ in found.offsets], dtype=np.int64)
            limits = np.concatenate([[0], np.cumsum([len(p) + 1 for p in own])])
            raw = ids.tobytes()
            cuts = (np.searchsorted(begins, limits) * ids.itemsize).tolist()
            self.parts.update((p, raw[a:b]) for p, a, b in zip(parts[low:low + 256], cuts[:-1], cuts[1:], strict=True))

    def _learn(self, fresh: list[bytes]) -> None:
        words = [p.rstrip(TAIL) for p in fresh]
        tails = [p[len(w):] for p, w in zip(fresh, words, strict=True)]
        for n, word in enumerate(words):
            if word.isalpha():
                words[n] = word.lower()
            elif not self._one_word(word):
                words[n], tails[n] = fresh[n], b""
        self._ask(list(set(words).union(tails).difference(self.parts)))
        known = self.parts
        self.pieces.update((p, known[w] + known[t]) for p, w, t in zip(fresh, words, tails, strict=True))

    @staticmethod
    def _one_word(raw: bytes) -> bool:
        """Letters only, and still so after normalization."""
        text = raw.decode("utf-8", "replace")
        return text.isalpha() and unicodedata.is_normalized("NFC", text) and text.lower().isalpha()

    def encode(self, raw_texts: list[bytes], end: bytes) -> list[bytes]:
        split = [raw.split() for raw in raw_texts]
        if len(self.pieces) > REMEMBERED or len(self.parts) > REMEMBERED:
            self.pieces, self.parts = {}, {b"": b""}
        fresh = set().union(*split).difference(self.pieces)
        if fresh:
            self._learn(list(fresh))
        known = self.pieces.__getitem__
        return [b"".join(map(known, pieces)) + end for pieces in split]


def encoder(path: str, width: int) -> PieceEncoder:
    """The encoder of a vocabulary, kept in the worker between tasks."""
    store = sys.modules.setdefault("_piece_encoder", types.ModuleType("_piece_encoder"))
    if getattr(store, "made_for", None) != (path, width):
        store.encoder, store.made_for = PieceEncoder(path, width), (path, width)
    return store.encoder


def write_shard(folder: str, tokenizer: str, end_id: int, width: int):
    """Arrow task over (shard, id, text) in id order: writes one shard, yields its manifest row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        own, files, shard, docs, tokens = encoder(tokenizer, width), [], None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            if not files:
                shard = batch.column("shard")[0].as_py()
                files = [store.open_output_stream(f"{root}/{name}.{kind}") for kind in ("ids", "offsets", "docs")]
                files[1].write(np.zeros(1, dtype="<i8").tobytes())
            files[2].write(batch.column("id").fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
            texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            for low in range(0, len(texts), 256):
                found = own.encode(texts[low:low + 256], end)
                ends = tokens + np.cumsum([len(x) // width for x in found], dtype="<i8")
                files[0].write(b"".join(found))
                files[1].write(ends.tobytes())
                docs, tokens = docs + len(found), int(ends[-1])
        for file in files:
            file.close()
        if docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()),
                 pa.array([tokens], pa.int64()), pa.array([width], pa.int32())],
                ["shard", "name", "n_docs", "n_tokens", "width"])

    return task


def mapped(store, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store has local files, else read."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=kind)
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype=kind)


def read_shards(folder: str, with_ids: bool):
    """Arrow task over manifest rows with ``base``: one row per document of the files."""
    step = 256

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                limits = mapped(store, f"{root}/{shard['name']}.offsets", "<i8")
                docs = mapped(store, f"{root}/{shard['name']}.docs", "<i8")
                ids = mapped(store, f"{root}/{shard['name']}.ids", f"<u{shard['width']}")
                for low in range(0, len(docs), step):
                    part = np.array(limits[low:low + step + 1])
                    flat = ids[part[0]:part[-1]].astype("<u4")
                    local = part - part[0]
                    own = np.array(docs[low:low + step])
                    checks = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(local[:-1], local[1:], strict=True)]
                    columns = [pa.array(own, mask=own == NO_ID), pa.array(part[:-1] + shard["base"]),
                               pa.array(np.diff(part)), pa.array(checks, pa.int64())]
                    names = ["id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(local.astype(np.int32)), pa.array(flat.astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return task


class TokenStore(NamedTuple):
    """A written corpus: its folder and its manifest with ``base``, the ids in all shards before."""

    folder: str
    manifest: DataFrame

    def documents(self, id: str = "doc_id", with_ids: bool = False) -> DataFrame:
        """(id, start, n_tokens, ids_crc32[, ids]) of every document, read from the files."""
        shape = "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
        count = max(1, self.manifest.count())
        rows = self.manifest.repartition(count, "shard").mapInArrow(read_shards(self.folder, with_ids), shape)
        return rows.withColumnRenamed("id", id)


def write_tokens(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int, vocabulary: int,
                 id: str = "doc_id", text: str = "text") -> TokenStore:
    """Write ``docs`` as shards in ascending id order.

    Ids of a vocabulary up to 65536 take 2 bytes, else 4. Null and empty texts hold the end id alone. Rows
    with a null id come first; equal ids are ordered by a hash of their text. An empty table writes no shard.
    """
    spark = docs.sparkSession
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    folder = scratch.path("tokens")
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(shards, F.col("id").asc_nulls_first()).sortWithinPartitions(
        F.col("id").asc_nulls_first(), F.xxhash64("text"))
    written = ordered.select(F.spark_partition_id().alias("shard"), "id", "text").mapInArrow(
        write_shard(folder, tokenizer, end_id, width), MANIFEST)
    manifest = scratch.cut(written, "manifest")
    # One row per shard: the prefix sum is over a table of a few numbers.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return TokenStore(folder, manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))))
