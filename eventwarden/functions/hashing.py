"""Content hashes: feature buckets and event fingerprints."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from eventwarden.functions.timestamps import iso_text

FINGERPRINT_FIELDS = (
    "action", "event_type", "message", "namespace", "pod_name", "resource", "resource_name",
    "service_name", "severity", "source_type", "status_code", "tags", "timestamp", "user_name",
)


def hash_bucket(value: Column, buckets: int) -> Column:
    """The 128-bit md5 of ``value`` as a number, modulo ``buckets``.

    The digest does not fit a long, so the remainder is carried through its
    hexadecimal digits in pieces of at most 48 bits: with fewer than 2**15
    buckets each step stays inside 63 bits.
    """
    if not 0 < buckets < 2 ** 15:
        raise ValueError("buckets must be between 1 and 32767")
    digest = F.md5(value.cast("binary"))
    rest = F.lit(0).cast("bigint")
    for start, digits in ((1, 12), (13, 12), (25, 8)):
        piece = F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")
        rest = F.pmod(rest * F.lit(16 ** digits) + piece, F.lit(buckets).cast("bigint"))
    return rest.cast("int")


def hash_bucket_once(value: Column, buckets: int) -> Column:
    """``hash_bucket`` for values that repeat: each batch of rows works out every value it holds once."""
    @F.arrow_udf("int")
    def bucket(values: pa.Array) -> pa.Array:
        coded = values.dictionary_encode()
        found = [int.from_bytes(hashlib.md5(v).digest(), "big") % buckets for v in coded.dictionary.to_pylist()]
        return pa.array(found, pa.int32()).take(coded.indices)

    return bucket(value.cast("binary"))


def fingerprint(timestamp: Column, **fields: Column) -> Column:
    """SHA-256 of the compact JSON of the identifying fields in name order."""
    empty = {
        "tags": F.array().cast("array<string>"),
        "status_code": F.lit(None).cast("int"),
    }
    parts = {"timestamp": iso_text(timestamp), **fields}
    columns = [
        parts.get(name, empty.get(name, F.lit(None).cast("string"))).alias(name)
        for name in FINGERPRINT_FIELDS
    ]
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sha2(text, 256)
