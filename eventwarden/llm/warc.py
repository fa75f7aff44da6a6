"""WARC archives: writing, and reading by boundary chains.

Writing: rows with equal payloads are one response, that with the largest id; the others are revisit records
that name it. Every task writes archives of its own under fresh names and reports them in a manifest.

Reading: archives are read in stretches, many per file. A task reports every place in its stretch that looks
like the head of a record, with the place where that record says it ends. A payload may hold such heads as
well. Records are what a chain from the start of the file reaches. Inside a stretch the task follows the
chains of all its candidates; from stretch to stretch pointer jumping doubles the reach with every round, so a file
of n stretches needs about log2(n) rounds. Heads inside payloads, which nothing points to, fall away. Only then
payloads are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.scratch import Scratch, open_store

MAGIC = b"WARC/1.0\r\n"
#: Bytes after which a task begins a new archive, and bytes of a stretch read by one task.
FILE_BYTES = 64 << 20
STRETCH = 8 << 20
#: Repeated payloads up to which their first ids are broadcast (about 10 MB); beyond, payloads are shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of a record head that are read at first; a longer head is read on until its end.
HEAD = 4096
MANIFEST = "file string, size bigint, n_records bigint"
CANDIDATE = ("file string, place bigint, next bigint, block bigint, block_length bigint, record_type string, "
             "page_id bigint, digest string, refers_to bigint, begin bigint, leaves bigint, enter bigint, last bigint")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds only the HTTP head."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if kind == "response" else http
    head = [MAGIC.decode().strip(), f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {clean}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(folder: str, file_bytes: int):
    """Arrow task over (id, url, payload, first): writes archives, yields manifest rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, done = None, []
        for batch in batches:
            for page, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "first")), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc", 0, 0
                    out = store.open_output_stream(f"{root}/{name}")
                kind = "response" if first is None or first == page else "revisit"
                raw = record(kind, page, url, payload, payload_digest(payload), first)
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        columns = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            ["file", "size", "n_records"])

    return task


def write_warc(pages: DataFrame, scratch: Scratch, id: str = "page_id", url: str = "url", payload: str = "html",
               least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write one record per row; the folder, and the manifest (file, size, n_records).

    The payload is the text in UTF-8, empty for null. Of equal payloads of at least ``least_bytes`` bytes the rows
    with the largest id are responses and the others revisit them; smaller payloads and rows with a null
    id are responses. Only id, url and payload are read, so other columns may have any name.
    """
    folder = scratch.path("warc")
    rows = pages.select(F.col(id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.select("id", F.when(F.octet_length("payload") >= least_bytes, F.unhex(F.sha1("payload"))).alias("print"))
    # Only the ids that revisit another page are joined back; payloads are not grouped.
    firsts = scratch.cut(keyed.where("print is not null and id is not null").groupBy("print").agg(
        F.max("id").alias("first"), F.min("id").alias("least")).where("least < first").select("print", "first"), "firsts")
    small = firsts.count() <= BROADCAST_ROWS
    marked = rows.withColumn("print", F.when(F.col("id").isNotNull() & (F.octet_length("payload") >= least_bytes),
                                             F.unhex(F.sha1("payload")))).join(
        F.broadcast(firsts) if small else firsts, "print", "left")
    written = marked.select("id", "url", "payload", "first").mapInArrow(write_archive(folder, file_bytes), MANIFEST)
    return folder, scratch.cut(written, "manifest")


def parse_head(raw: bytes) -> dict[str, str]:
    fields = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return fields


def _number(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def candidates(folder: str):
    """Arrow task over (file, size, begin, end): every place in the stretch that looks like a record head.

    Within a stretch the task follows the chains itself: ``leaves`` is the first place behind the stretch to which a
    head leads, null if its chain breaks. Heads form trees, in which every head is below its successor; ``enter`` is
    a head's number in an order where the heads that lead to it come after it, up to ``last``.
    """

    def follow(rows: list[dict], end: int) -> None:
        at = {row["place"]: row for row in rows}
        below: dict[int, list[dict]] = {}
        roots = []
        for row in reversed(rows):
            after = at.get(row["next"])
            row["leaves"] = after["leaves"] if after else row["next"] if row["next"] >= end else None
            if after:
                below.setdefault(row["next"], []).append(row)
            else:
                roots.append(row)
        # Successors lie behind, so sizes add up in order of place.
        sizes = {row["place"]: 1 for row in rows}
        for row in rows:
            if row["next"] in at:
                sizes[row["next"]] += sizes[row["place"]]
        number = 0
        for root in roots:
            root["enter"], number = number, number + sizes[root["place"]]
        for row in reversed(rows):
            row["last"] = row["enter"] + sizes[row["place"]] - 1
            spot = row["enter"] + 1
            for child in below.get(row["place"], ()):
                child["enter"], spot = spot, spot + sizes[child["place"]]

    def heads(source, size: int, begin: int, end: int) -> Iterator[dict]:
        source.seek(begin)
        data = source.read(min(end + len(MAGIC) - 1, size) - begin)
        at = data.find(MAGIC)
        while 0 <= at < end - begin:
            raw, reach = data[at:at + HEAD], HEAD
            while b"\r\n\r\n" not in raw and begin + at + len(raw) < size:
                source.seek(begin + at)
                raw, reach = source.read(reach), reach * 2
            stop = raw.find(b"\r\n\r\n")
            if stop >= 0:
                fields = parse_head(raw[:stop])
                length = fields.get("content-length", "")
                if length.isascii() and length.isdigit() and len(length) < 19:
                    block = begin + at + stop + 4
                    after = block + int(length) + 4
                    if after <= size:
                        yield {"place": begin + at, "next": after, "block": block, "block_length": int(length),
                               "record_type": fields.get("warc-type"), "page_id": _number(fields.get("warc-record-id")),
                               "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                               "refers_to": _number(fields.get("warc-refers-to"))}
            at = data.find(MAGIC, at + 1)

    names = [f.split()[0] for f in CANDIDATE.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in CANDIDATE.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for part in batch.to_pylist():
                with store.open_input_file(f"{root}/{part['file']}") as source:
                    found = [{"file": part["file"], "begin": part["begin"], **x}
                             for x in heads(source, part["size"], part["begin"], part["end"])]
                follow(found, part["end"])
                yield pa.RecordBatch.from_pylist([{n: x[n] for n in names} for x in found], schema=schema)

    return task


def reachable(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The candidates that the chain from place 0 of their file reaches.

    Chains inside a stretch are known, so only heads at which a chain comes in from another stretch take part:
    after round k, ``jumps`` leads 2**k stretches ahead and ``reached`` holds the first 2**k entries of every chain. A
    chain only goes forward, so it enters a stretch once, and there it takes the heads that this entry is below.
    """
    doors = found.where("leaves is not null").select("file", F.col("leaves").alias("place")).union(
        found.where("place = 0").select("file", "place")).distinct()
    doors = scratch.cut(found.join(doors, ["file", "place"], "left_semi").select("file", "place", "leaves"), "doors")
    jumps = doors.where("leaves is not null")
    reached = scratch.cut(doors.where("place = 0").select("file", "place"), "reached")
    while True:
        ahead = reached.join(jumps, ["file", "place"]).select("file", F.col("leaves").alias("place"))
        more = scratch.cut(ahead.join(doors.select("file", "place"), ["file", "place"], "left_semi"), "more")
        if more.isEmpty():
            break
        reached = scratch.cut(reached.unionByName(more), "reached")
        then = jumps.alias("a").join(jumps.alias("b"), F.expr("a.file = b.file and a.leaves = b.place")).select(
            F.col("a.file").alias("file"), F.col("a.place").alias("place"), F.col("b.leaves").alias("leaves"))
        jumps = scratch.cut(then, "jumps")
    entries = scratch.cut(found.join(reached, ["file", "place"], "left_semi").select(
        "file", "begin", F.col("enter").alias("entry")), "entries")
    return found.join(entries, ["file", "begin"]).where("entry between enter and last").drop("entry")


def read_payloads(folder: str, with_payload: bool):
    """Arrow task over records: payload size and digest, from the bytes in the file."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        held, source = None, None
        for batch in batches:
            sizes, digests, payloads = [], [], []
            for name, block, length, kind in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "block_length", "record_type")), strict=True):
                if name != held:
                    if source is not None:
                        source.close()
                    held, source = name, store.open_input_file(f"{root}/{name}")
                source.seek(block)
                raw = source.read(length)
                payload = raw[raw.find(b"\r\n\r\n") + 4:]
                whole = kind != "revisit"
                sizes.append(len(payload) if whole else None)
                digests.append(payload_digest(payload) if whole else None)
                if with_payload:
                    payloads.append(payload if whole else None)
            columns = [*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
            names = [*batch.schema.names, "payload_bytes", "seen_digest"]
            if with_payload:
                columns.append(pa.array(payloads, pa.binary()))
                names.append("payload")
            yield pa.RecordBatch.from_arrays(columns, names)
        if source is not None:
            source.close()

    return task


def read_warc(folder: str, files: DataFrame, scratch: Scratch, stretch: int = STRETCH, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record.

    ``files`` has (file, size). Sizes and digests are of payloads as read; a revisit has those of the
    response it refers to (null if there is none). An empty manifest has no records.
    """
    spark = files.sparkSession
    parts = files.where("size > 0").select("file", "size", F.explode(F.expr(f"sequence(0L, size - 1, {stretch}L)")).alias("begin"))
    parts = parts.withColumn("end", F.least(F.col("begin") + stretch, F.col("size")))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.cut(parts.repartition(width, "file", "begin").mapInArrow(candidates(folder), CANDIDATE), "candidates")
    records = reachable(found, scratch)
    # Neighbours in a file go to one task; a file is cut into stretches, so none is a task's alone.
    ordered = records.repartition(width, "file", "begin").sortWithinPartitions("file", "place")
    kept = ordered.select("file", "block", "block_length", "record_type", "page_id", "digest", "refers_to")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    shape += ", payload_bytes bigint, seen_digest string" + (", payload binary" if with_payload else "")
    read = scratch.cut(kept.mapInArrow(read_payloads(folder, with_payload), shape), "records")
    whole = read.where("record_type <> 'revisit'")
    more = ["payload"] if with_payload else []
    plain = whole.select("page_id", "payload_bytes", F.col("seen_digest").alias("payload_digest"), "record_type", "refers_to", *more)
    # Written, as a join with an aggregate could not split a payload that very many records revisit.
    told = scratch.cut(whole.where("page_id is not null").select(
        F.col("page_id").alias("refers_to"), F.col("seen_digest").alias("digest"), "payload_bytes").distinct(), "told")
    again = read.where("record_type = 'revisit'").select("page_id", "digest", "record_type", "refers_to").join(
        told, ["refers_to", "digest"], "left").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to",
        *[F.lit(None).cast("binary").alias(c) for c in more])
    return plain.unionByName(again)
