"""Streams of events: ingest, late rows, deduplication, panels, throttling.

Stateless steps are the batch jobs themselves. Steps that look back use event time
and a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventwarden import constants as K
from eventwarden.operators.dedup import throttle
from eventwarden.operators.normalize import normalize_events, open_envelope, quarantine
from eventwarden.operators.policy import drop_noise, shape_fields
from eventwarden.operators.tagging import tag_events
from eventwarden.plans.ingest import ingest, ingest_report, outcome_columns
from eventwarden.session import cut_lineage, drop_copies

WATERMARK = "10 minutes"


def split_late(events: DataFrame, delay: str = WATERMARK) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows whose event time lies more than ``delay`` before arrival."""
    edge = F.col("ingest_ts") - F.expr(f"INTERVAL {delay}")
    late = F.col("timestamp") < edge
    return events.where(~late), events.where(late)


def start_ingest(lines: DataFrame, table: str, quarantine_table: str, checkpoint: str, every: str | None = None,
                 late_table: str | None = None, delay: str = WATERMARK, remember: str = "1 day",
                 report_table: str | None = None) -> StreamingQuery:
    """Lines to stored events and quarantine; a batch run twice replaces itself.

    An event that came before within ``remember``, by arrival, is not stored again; it is known by its id and stage,
    which are kept as state. Events that happened more than ``delay`` before they arrived go to ``late_table``,
    where one is named. Events are laid out by day and batch, so a day can be removed as a folder.
    ``report_table`` gets the ``ingest_report`` of every batch, which is worked from the batch's written copy; a
    replayed event counts once, and dropped events are carried as their outcome alone.
    Without ``every`` the stream works off what is there and ends.
    """
    items = open_envelope(lines)
    arrived = items if "ingest_ts" in items.columns else items.withColumn("ingest_ts", F.current_timestamp())
    bad = quarantine(items).select(F.struct("source_type", "body", "problem").alias("bad"), F.struct(
        F.lit(None).cast("string").alias("event_id"), "source_type", F.lit(None).cast("string").alias("severity"),
        F.lit("failed").alias("outcome")).alias("fact"))
    if report_table:
        # Dropped events are judged too, so that they can be counted; only what is stored goes on whole.
        events = dedup_stream(shape_fields(tag_events(drop_noise(normalize_events(arrived)))), clock="ingest_ts", delay=remember)
        fact = F.struct(*outcome_columns())
        event = F.when(fact["outcome"] == "stored", F.struct(*events.columns))
    else:
        events = dedup_stream(ingest(arrived), clock="ingest_ts", delay=remember)
        fact, event = F.lit(None), F.struct(*events.columns)
    both = events.select(event.alias("event"), fact.cast(bad.schema["fact"].dataType).alias("fact")).unionByName(
        bad, allowMissingColumns=True)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch)
        rows = batch.where("event IS NOT NULL").select("event.*")
        fine, late = split_late(rows, delay) if late_table else (rows, None)
        for found, path, by in ((fine, table, ["event_date"]), (late, late_table, ["event_date"]),
                                (batch.where("bad IS NOT NULL").select("bad.*"), quarantine_table, [])):
            if found is not None:
                (found.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch_id").parquet(path))
        if report_table:
            (ingest_report(batch.select("fact.*")).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(report_table))
        drop_copies(batch)

    writer = both.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def dedup_stream(events: DataFrame, keys: tuple[str, ...] = ("event_id", "stage"), delay: str = WATERMARK,
                 clock: str = "timestamp") -> DataFrame:
    """Drop repeats of an event within ``delay`` of the newest ``clock``; the first one stays."""
    return events.withWatermark(clock, delay).dropDuplicatesWithinWatermark(list(keys))


def counts_over_time(events: DataFrame, *columns: str, width: str = "5 minutes", step: str | None = None,
                     delay: str = WATERMARK) -> DataFrame:
    slot = F.window("timestamp", width, step) if step else F.window("timestamp", width)
    return events.withWatermark("timestamp", delay).groupBy(slot.alias("slot"), *columns).agg(
        F.count("*").alias("events")).select(
        F.col("slot.start").alias("start"), F.col("slot.end").alias("end"), *columns, "events")


def bursts(events: DataFrame, key: str = "user_name", gap: str = "5 minutes", delay: str = WATERMARK) -> DataFrame:
    """Runs of a key's events with no pause longer than the gap."""
    return events.withWatermark("timestamp", delay).groupBy(
        F.session_window("timestamp", gap).alias("run"), key).agg(F.count("*").alias("events")).select(
        key, F.col("run.start").alias("start"), F.col("run.end").alias("end"), "events")


def start_throttle(alerts: DataFrame, table: str, checkpoint: str, label: str = "classification",
                   us: str = "us", gap_us: int = K.NOISY_GAP_SECONDS * K.SECOND_US) -> StreamingQuery:
    """Thin out noisy alerts batch by batch, exactly as the batch job would.

    What earlier batches kept is read back from the table, so a class with very many
    alerts is worked in parallel like in the batch job.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = None
        first = batch.agg(F.min(us)).first()[0]
        if batch_id > 0 and first is not None:
            # Only what was kept within one gap before this batch can hold rows back.
            done = spark.read.schema(batch.schema.add("batch_id", "long")).parquet(table)
            kept = done.where(
                (F.col("batch_id") < batch_id) & (F.col(us) > first - gap_us)
                & F.col(label).isin(*K.NOISY_CLASSES)).select(label, us)
        (throttle(batch, label, us, gap_us=gap_us, kept_before=kept)
         .withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table))

    return (alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class _Spaced(StatefulProcessor):
    """Remembers the last kept instant of a class; rows arrive in order of arrival."""

    def __init__(self, us: str, gap_us: int):
        self.us, self.gap_us = us, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_kept", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for chunk in rows:
            keep = []
            for spot, at in enumerate(chunk[self.us]):
                if last is None or at - last >= self.gap_us:
                    keep.append(spot)
                    last = int(at)
            if keep:
                yield chunk.iloc[keep]
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def throttle_live(alerts: DataFrame, label: str = "classification", us: str = "us",
                  gap_us: int = K.NOISY_GAP_SECONDS * K.SECOND_US) -> DataFrame:
    """Low-latency throttling of the noisy classes with keyed state, one number per class."""
    noisy = alerts.where(F.col(label).isin(*K.NOISY_CLASSES))
    return noisy.groupBy(label).transformWithStateInPandas(
        statefulProcessor=_Spaced(us, gap_us), outputStructType=noisy.schema,
        outputMode="Append", timeMode="None")
