"""Stored versions of events, last write wins, in a table that is appended to and compacted from time to time.

``log/batch_id=n`` holds what batches wrote; ``base/version=n`` holds the last version of every id as of a
compaction, in a fixed number of files; ``pointer`` has one row per compaction. A reader takes the newest base and
the batches after it, so it always sees a whole state. The newest pointer row switches readers; what it
replaces stays for one more compaction, for readers that are still at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventwarden.operators.dedup import last_version
from eventwarden.sources.files import folders, remove


def append_versions(rows: DataFrame, folder: str, batch_id: int) -> None:
    """Write the rows of a batch; a batch that runs twice replaces its own rows."""
    rows.write.mode("overwrite").parquet(f"{folder}/log/batch_id={batch_id}")


def _pointer(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """(version, last batch in it) of all compactions, newest first."""
    if not folders(spark, folder, "pointer"):
        return []
    rows = spark.read.schema("version bigint, upto bigint").parquet(f"{folder}/pointer").collect()
    return sorted(((r["version"], r["upto"]) for r in rows), reverse=True)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(name.partition("=")[2]) for name in folders(spark, f"{folder}/log", "batch_id="))


def _versions(spark: SparkSession, folder: str, schema: str | None, upto: int | None) -> tuple[DataFrame | None, int]:
    """All stored rows up to a batch with ``_batch``, and the last batch among them."""
    pointer = _pointer(spark, folder)
    version, done = pointer[0] if pointer else (0, -1)
    new = [n for n in _batches(spark, folder) if n > done and (upto is None or n <= upto)]
    reader = spark.read.schema(schema) if schema else spark.read
    parts = [reader.parquet(f"{folder}/base/version={version}").withColumn("_batch", F.lit(done).cast("bigint"))] if pointer else []
    if new:
        log = reader.parquet(*[f"{folder}/log/batch_id={n}" for n in new])
        number = F.regexp_extract(F.col("_metadata.file_path"), "batch_id=([0-9]+)", 1).cast("bigint")
        parts.append(log.withColumn("_batch", number))
    if not parts:
        return None, done
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return rows, new[-1] if new else done


def read_versions(spark: SparkSession, folder: str, key: str = "event_id", by: str = "ingest_ts",
                  schema: str | None = None) -> DataFrame | None:
    """The last version of every id: the latest ``by``, then the latest batch; None before the first batch."""
    rows, _ = _versions(spark, folder, schema, None)
    return None if rows is None else last_version(rows, key, (by, "_batch")).drop("_batch")


def compact(spark: SparkSession, folder: str, key: str = "event_id", by: str = "ingest_ts", buckets: int = 64,
            schema: str | None = None) -> int:
    """Merge the batches so far into a new base of ``buckets`` files and switch readers to it; its version.

    Batches that come meanwhile stay in the log. Nothing new gives no new version.
    """
    pointer = _pointer(spark, folder)
    version = pointer[0][0] if pointer else 0
    rows, upto = _versions(spark, folder, schema, None)
    if rows is None or (pointer and upto == pointer[0][1]):
        return version
    merged = last_version(rows, key, (by, "_batch")).drop("_batch")
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    merged.repartitionById(buckets, place).write.mode("overwrite").parquet(f"{folder}/base/version={version + 1}")
    spark.createDataFrame([(version + 1, upto)], "version bigint, upto bigint").coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    # What the pointer before this one had merged is read by nobody any more.
    if pointer:
        remove(spark, *[f"{folder}/log/batch_id={n}" for n in _batches(spark, folder) if n <= pointer[0][1]])
        remove(spark, *[f"{folder}/base/{name}" for name in folders(spark, f"{folder}/base", "version=")
                        if int(name.partition("=")[2]) < version])
    return version + 1
