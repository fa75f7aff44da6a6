"""Where events go. Every sink is a plain table write, safe to retry."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventwarden.operators.dedup import last_version
from eventwarden.session import cut_lineage, drop_copies
from eventwarden.sources.files import folders, remove


def without_private_fields(events: DataFrame) -> DataFrame:
    return events.select(*[c for c in events.columns if not c.startswith("_")])


def append_event_store(events: DataFrame, path: str) -> None:
    """Append JSON lines, one folder per day."""
    without_private_fields(events).write.mode("append").partitionBy("event_date").json(path)


def append_table(events: DataFrame, path: str, by: str = "event_date") -> None:
    without_private_fields(events).write.mode("append").partitionBy(by).parquet(path)


def index_view(spark: SparkSession, path: str) -> DataFrame:
    """The appended table as an index keeps it: the last version of each id."""
    return last_version(spark.read.parquet(path))


def replace_batch(path: str, by: str = "event_date") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: a batch run twice replaces its own rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", by).parquet(path))
    return write


def kafka_rows(items: DataFrame, source: str = "audit", wrapped: bool = True) -> DataFrame:
    """Items as messages: ``value`` holds the envelope, or the bare event."""
    if not wrapped:
        return items.select(F.col("body").alias("value"))
    body = F.concat(
        F.lit('{"source_type":"'), F.col("source_type"), F.lit(f'","source":"{source}","event":'),
        F.col("body"), F.lit("}"))
    return items.select(body.alias("value"))


def to_kafka(rows: DataFrame, servers: str, topic: str) -> None:
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def scored_documents(scored: DataFrame, topic: str | Column = "source_topic") -> DataFrame:
    """Scored events as documents: input, output and the promoted fields."""
    inputs = ("user", "method", "object_type", "namespace", "source_ip", "event_type", "ts")
    outputs = ("anomaly_score", "if_score", "seq_score", "seq_active", "risk_level", "reason", "model_version")
    raw = F.col("raw_event") if "raw_event" in scored.columns else F.lit(None).cast("string")
    where = F.col(topic) if isinstance(topic, str) and topic in scored.columns else (
        F.lit(topic) if isinstance(topic, str) else topic)
    return scored.select(
        F.current_timestamp().alias("stored_at"), where.alias("source_topic"),
        F.col("event_type").alias("source_type"), raw.alias("raw_event"),
        F.struct(*inputs).alias("ml_input"), F.struct(*outputs).alias("ml_output"),
        "risk_level", "anomaly_score", "reason", "user", "namespace", "method", "object_type", "source_ip",
        F.to_date("ts").alias("event_date"))


def purge(spark: SparkSession, path: str, days: float, now: datetime | None = None) -> dict[str, int]:
    """Drop the rows out of retention from a table laid out by ``event_date``, in place.

    Days that lie wholly before the edge are removed as folders, unread; only the edge day is rewritten, from a copy
    of its kept rows. Returns how many days were removed and rewritten. A run that ends early is finished
    by the next; nothing happens when ``days`` is not positive. Rows without a day stay.
    """
    if days <= 0:
        return {"removed": 0, "rewritten": 0}
    now = now or datetime.now(timezone.utc)
    edge = now.astimezone(timezone.utc) - timedelta(days=max(1, int(days)))
    listed = [name for name in folders(spark, path, "event_date=") if name.partition("=")[2][:1].isdigit()]
    old = [name for name in listed if name.partition("=")[2] < f"{edge:%Y-%m-%d}"]
    remove(spark, *[f"{path}/{name}" for name in old])
    day, instant = f"event_date={edge:%Y-%m-%d}", F.lit(f"{edge:%Y-%m-%d %H:%M:%S.%f}+00:00").cast("timestamp")
    if day not in listed:
        return {"removed": len(old), "rewritten": 0}
    rows = spark.read.parquet(f"{path}/{day}")
    if not rows.where(F.col("timestamp") < instant).limit(1).count():
        return {"removed": len(old), "rewritten": 0}
    kept = cut_lineage(rows.where(F.col("timestamp") >= instant))
    kept.write.mode("overwrite").parquet(f"{path}/{day}")
    drop_copies(kept)
    return {"removed": len(old), "rewritten": 1}
