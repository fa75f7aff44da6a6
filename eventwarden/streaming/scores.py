"""Score a stream of events against the history of their users and addresses.

History, features and the last steps of each user are state of the stream (``online``), under its
checkpoint: nothing is read back from tables, and a restart goes on where it stopped. The newest published
models are looked up for each batch. A batch that runs twice writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventwarden.plans.features import with_event_flags
from eventwarden.plans.ingest import scorer_input
from eventwarden.plans.scoring import (
    ForestModel, SequenceModel, current_forest, current_sequence, score_events, select_alerts,
)
from eventwarden.session import cut_lineage, drop_copies
from eventwarden.sources.readers import by_topic
from eventwarden.streaming.online import online_matrix, online_windows, with_clock

HISTORY_COLUMNS = ("event_id", "ts", "user", "source_ip", "namespace", "object_type", "method",
                   "event_type", "is_failed")
#: What the state operators read; everything else travels as one text beside them.
STATE_COLUMNS = ("event_id", "us", "user", "source_ip", "namespace", "object_type", "method", "event_type",
                 "is_failed", "hour", "day_of_week", "is_off_hours", "is_sensitive", "is_high_risk", "is_rbac")


def online_rows(inputs: DataFrame) -> DataFrame:
    """A stream of scorer input with its features and windows; unreadable rows pass without them.

    A row is unreadable if it has no time or no event id.
    """
    unreadable = F.col("ts").isNull() | F.col("event_id").isNull()
    flagged = with_event_flags(inputs.where(~unreadable)).withColumn("is_failed", F.coalesce("is_failed", F.lit(0)))
    rest = flagged.select(*[c for c in flagged.columns if c not in (*STATE_COLUMNS, "ts")])
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    carried = [F.to_json(F.struct(*rest.columns), options).alias("carried")] if rest.columns else []
    matrix = online_matrix(with_clock(flagged.select(*STATE_COLUMNS, *carried)))
    rows = online_windows(matrix).drop("clock").withColumn("ts", F.timestamp_micros("us"))
    if carried:
        others = F.from_json("carried", rest.schema, options)
        rows = rows.withColumn("_rest", others).select("*", "_rest.*").drop("_rest", "carried")
    return rows.unionByName(inputs.where(unreadable), allowMissingColumns=True)


def score_batch(batch: DataFrame, batch_id: int, folder: str, forest: ForestModel,
                sequence: SequenceModel | None) -> None:
    """Score one micro-batch of ``online_rows`` and write scores and alerts; unreadable rows are kept apart."""
    # Written once: state is read once, and the scores feed two tables.
    batch = cut_lineage(batch)
    unreadable = F.col("ts").isNull() | F.col("event_id").isNull()
    _write(batch.where(unreadable), f"{folder}/unreadable", batch_id)
    scored = cut_lineage(score_events(batch.where(~unreadable), forest, sequence))
    _write(scored, f"{folder}/scored", batch_id)
    _write(select_alerts(scored), f"{folder}/alerts", batch_id)
    drop_copies(batch, scored)


def _write(rows: DataFrame, path: str, batch_id: int) -> None:
    (rows.withColumns({"batch_id": F.lit(batch_id), "event_date": F.to_date("ts")})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date", "batch_id").parquet(path))


def start_scoring(messages: DataFrame, folder: str, models: str, checkpoint: str,
                  every: str | None = None) -> StreamingQuery:
    """Topic messages ``(topic, value)`` to scored events and alerts.

    The newest published models are looked up for each batch.
    """
    inputs = scorer_input(by_topic(messages))
    if "event_id" not in inputs.columns:
        inputs = inputs.withColumn("event_id", F.xxhash64("body"))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        forest = current_forest(spark, models)
        if forest is None:
            raise RuntimeError("no forest has been published")
        score_batch(batch, batch_id, folder, forest, current_sequence(spark, models))

    writer = online_rows(inputs).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
