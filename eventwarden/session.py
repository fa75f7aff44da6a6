"""Session settings the jobs rely on, and where lineage may be cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Event time is UTC everywhere: hours, weekdays and day partitions depend on it.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles methods above 8000 bytes; the long rule expressions
    # run faster as several smaller methods than as one fused stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "eventwarden", cores: int | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use ``prepare``."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for name, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder would lose data together with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="eventwarden-"))
    return context.getCheckpointDir()


#: Rows of one task after ``spread``; a larger table gets more tasks, not longer ones.
SPREAD_ROWS = 250_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core some rows of a scan that has fewer splits than cores, and no task very many.

    For work that is heavy per row. Splits follow the bytes of a file, so narrow rows come many to a
    split, and a file of one block fills one split only. A table of many small splits passes unchanged;
    the frame must be a scan or a written copy, not the result of a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-df.count() // SPREAD_ROWS))
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df


def cut_lineage(df: DataFrame, by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written copy.

    A written table runs the job once; ``checkpoint`` would run its last stage twice.
    With ``by`` the copy is laid out by that column, so filters on it skip files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


#: Lets a job remove the files of its shuffles when it has ended; else they stay until the driver collects garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside leave no shuffle files; for jobs that end in a written copy."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)


def drop_copies(*frames: DataFrame) -> None:
    """Delete copies of ``cut_lineage`` that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
