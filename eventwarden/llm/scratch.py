"""Written copies in the shared folder, and plain files there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from eventwarden.llm.words import release
from eventwarden.session import shared_folder


#: How many rows Spark hands to a Python task at a time.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """A folder of one job below ``spark.checkpoint.dir``.

    ``cut`` writes a frame and reads it back, which ends its lineage. ``drop`` removes copies that
    no later result reads; copies a returned frame still reads stay until the folder is cleared.
    With ``batch_rows``, tasks get that many rows at a time while a copy is written; results are the same.
    """

    def __init__(self, spark: SparkSession, name: str, batch_rows: int | None = None):
        self.spark, self.batch_rows = spark, batch_rows
        # With its scheme, so that tasks which open files themselves find the same store as Spark.
        path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.folder = f"{store.makeQualified(path).toString().rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def cut(self, df: DataFrame, name: str = "cut") -> DataFrame:
        path = self.path(name)
        with self._batches():
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        back._written_to = path
        return back

    @contextmanager
    def _batches(self) -> Iterator[None]:
        before = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(self.batch_rows or before))
        try:
            yield
        finally:
            self.spark.conf.set(BATCH, before)

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._written_to)
            path.getFileSystem(conf).delete(path, True)


def in_parts(batches, rows: int = 256):
    """Arrow batches of at most ``rows`` rows, for tasks that hold a batch's texts as Python values."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
        release()


def open_store(uri: str):
    """A file system and the path in it, for use inside tasks."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
