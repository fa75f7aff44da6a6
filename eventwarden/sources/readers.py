"""Where events come from, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventwarden import schemas as S
from eventwarden.functions.timestamps import parse_text

TOPICS = ("k8s-audit-raw", "falco-alerts")
_TOPIC_SOURCE = {"k8s-audit-raw": "k8s_audit", "falco-alerts": "falco"}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of the active and rotated files of a glob, as ``value``."""
    return spark.read.text(path).where(F.trim("value") != "")


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger)
            .load(path).where(F.trim("value") != ""))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds a JSON array or one envelope per line, as ``value`` items."""
    return spark.read.text(path).select(F.explode(F.coalesce(
        F.from_json("value", "array<string>"), F.array("value"))).alias("value"))


def kafka(spark: SparkSession, servers: str, topics=TOPICS, streaming: bool = True, **options: str) -> DataFrame:
    """``(topic, value, ingest_ts)`` rows of the event topics.

    Needs the Kafka connector on the class path.
    """
    reader = spark.readStream if streaming else spark.read
    source = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    if streaming:
        source = source.option("startingOffsets", "latest")
    for name, value in options.items():
        source = source.option(name, value)
    return source.load().select("topic", F.col("value").cast("string").alias("value"),
                                F.col("timestamp").alias("ingest_ts"))


def by_topic(messages: DataFrame) -> DataFrame:
    """Topic messages to ``(source_type, body)`` items; other topics are dropped.

    An audit message may be wrapped in an envelope, an alert never is.
    """
    known = messages.where(F.col("topic").isin(*TOPICS))
    env = F.from_json("value", S.ENVELOPE)["event"]
    table = F.create_map(*[F.lit(x) for pair in _TOPIC_SOURCE.items() for x in pair])
    source = table[F.col("topic")]
    body = F.when((source == "k8s_audit") & env.startswith("{"), env).otherwise(F.col("value"))
    return known.withColumns({"source_type": source, "body": body})


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Training history with a header; rows without a readable time are left out."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(*[
        (F.col(f"`{title}`") if title in raw.columns else F.lit(None).cast("string")).alias(name)
        for title, name in S.HISTORY_COLUMNS.items()])
    ts = F.coalesce(parse_text(F.col("timestamp_utc")), parse_text(F.col("invocation_time")))
    failed = (F.lower(F.coalesce(F.trim("result"), F.lit("unknown"))) != "success").cast("int")
    return (
        rows.withColumns({"ts": ts, "is_failed": failed}).where("ts IS NOT NULL")
        .drop("timestamp_utc", "invocation_time")
        .withColumn("event_id", F.xxhash64("ts", "user", "source_ip", "method", "object_type", "object_name"))
    )


def read_event_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events appended as JSON lines per day; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
