"""From raw items to kept events and to scorer input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden import schemas as S
from eventwarden.functions.rules import status_result
from eventwarden.functions.timestamps import event_time
from eventwarden.operators.normalize import normalize_events, quarantine
from eventwarden.operators.policy import apply_namespace_policy, drop_noise, is_kept, shape_fields
from eventwarden.operators.tagging import tag_events


def ingest(items: DataFrame, allowed: list[str] | None = None,
           ignored: tuple[str, ...] = K.IGNORED_NAMESPACES, keep: list[str] | None = None,
           store_raw: bool = True, max_raw_bytes: int | None = None) -> DataFrame:
    """Items to the events that are stored. Runs the same on batch and stream.

    Raw events stay whole unless ``max_raw_bytes`` is given.
    """
    events = tag_events(drop_noise(normalize_events(items)))
    return shape_fields(apply_namespace_policy(events, allowed, ignored), keep, store_raw, max_raw_bytes)


#: Columns that tell what became of an item.
OUTCOME = ("event_id", "source_type", "severity", "outcome")


def outcome_columns(allowed: list[str] | None = None, ignored: tuple[str, ...] = K.IGNORED_NAMESPACES) -> list[Column]:
    """``OUTCOME`` of an event: the namespace policy stores it or drops it."""
    kept = is_kept(F.col("source_type"), F.col("namespace"), F.col("status_code"),
                   F.col("classification"), allowed, ignored)
    return [*[F.col(c) for c in OUTCOME[:3]], F.when(kept, "stored").otherwise("dropped").alias("outcome")]


def failures(items: DataFrame) -> DataFrame:
    """``OUTCOME`` of the items that go to quarantine; they have neither an id nor a severity."""
    none = F.lit(None).cast("string")
    return quarantine(items).select(none.alias("event_id"), "source_type", none.alias("severity"),
                                    F.lit("failed").alias("outcome"))


def outcomes(items: DataFrame, allowed: list[str] | None = None,
             ignored: tuple[str, ...] = K.IGNORED_NAMESPACES) -> DataFrame:
    """What becomes of every accepted item: ``OUTCOME`` columns. Noise is not accepted at all."""
    events = drop_noise(normalize_events(items))
    return events.select(*outcome_columns(allowed, ignored)).unionByName(failures(items))


def _field(fields: Column, key: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(fields, F.lit(key)), F.lit(default))


def scorer_input(items: DataFrame) -> DataFrame:
    """Audit and alert items as scorer input; other sources are left out.

    Rows keep their columns beside ``source_type`` and ``body``.
    """
    extra = [c for c in items.columns if c not in ("source_type", "body")]
    a = F.from_json("body", S.AUDIT)
    ref = a["objectRef"]
    audit = items.where(F.col("source_type") == "k8s_audit").select(
        *extra, "body",
        F.coalesce(a["user"]["username"], F.lit("unknown")).alias("user"),
        F.coalesce(a["verb"], F.lit("unknown")).alias("method"),
        F.coalesce(ref["resource"], F.lit("unknown")).alias("object_type"),
        F.coalesce(F.nullif(ref["namespace"], F.lit("")), F.lit("cluster-wide")).alias("namespace"),
        F.coalesce(F.get(a["sourceIPs"], F.lit(0)), F.lit("unknown")).alias("source_ip"),
        status_result(a["responseStatus"]["code"]).alias("result"),
        event_time(F.coalesce(a["requestReceivedTimestamp"], a["stageTimestamp"])).alias("ts"),
        F.coalesce(F.nullif(ref["name"], F.lit("")), F.lit("N/A")).alias("object_name"),
        F.lit("k8s_audit").alias("event_type"),
        F.coalesce(a["level"], F.lit("Metadata")).alias("classification"),
        F.coalesce(a["userAgent"], F.lit("unknown")).alias("requesting_service"),
    )
    f = F.from_json("body", S.FALCO)
    out = f["output_fields"]
    falco = items.where(F.col("source_type") == "falco").select(
        *extra, "body",
        _field(out, "user.name", "unknown").alias("user"),
        F.coalesce(f["rule"], F.lit("unknown")).alias("method"),
        F.lit("runtime_event").alias("object_type"),
        F.coalesce(F.nullif(F.try_element_at(out, F.lit("k8s.ns.name")), F.lit("")), F.lit("default")).alias("namespace"),
        _field(out, "fd.name", "unknown").alias("source_ip"),
        F.lit("Success").alias("result"),
        event_time(f["time"]).alias("ts"),
        _field(out, "k8s.pod.name", "").alias("object_name"),
        F.lit("falco").alias("event_type"),
        F.coalesce(f["priority"], F.lit("Notice")).alias("classification"),
        _field(out, "proc.name", "unknown").alias("requesting_service"),
    )
    return audit.unionByName(falco).withColumn(
        "is_failed", (F.lower("result") != "success").cast("int"))


def complete_input(rows: DataFrame) -> DataFrame:
    """Scorer input given field by field: missing or empty fields get their default.

    A missing result counts as success; a missing time stays null, so the row goes to
    the unreadable ones instead of being scored at the present time.
    """
    def filled(name: str, default: str) -> Column:
        if name not in rows.columns:
            return F.lit(default)
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))

    names = ("event_type", "classification", "user", "method", "source_ip", "namespace", "object_type",
             "object_name")
    out = rows.withColumns({n: filled(n, "unknown") for n in names} | {"result": filled("result", "Success")})
    ts = event_time(F.col("timestamp_utc")) if "timestamp_utc" in rows.columns else F.col("ts")
    return out.withColumns({"ts": ts, "is_failed": (F.lower(F.trim("result")) != "success").cast("int")})


def sample_ids(found: DataFrame, count: int = 10) -> DataFrame:
    """A few ids of a batch, for its summary: the first ones in order of text."""
    return found.where("event_id IS NOT NULL").select("event_id").orderBy("event_id").limit(count)


def ingest_report(outcomes: DataFrame, ids: int = 10) -> DataFrame:
    """Accepted, stored, dropped and failed items by source, by severity and in total, in one pass.

    ``(dimension, value, accepted, stored, dropped, failed, ids)``; the total names a few stored events. A source or
    severity that is not known counts as ``unknown``. Reports of disjoint batches add up to the report of all.
    """
    by = [F.col("source_type"), F.col("severity")]
    counted = outcomes.groupingSets([[by[0]], [by[1]], []], *by).agg(
        F.count("*").alias("accepted"), F.grouping_id().alias("_set"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("stored", "dropped", "failed")])
    listed = sample_ids(outcomes.where("outcome = 'stored'"), ids).agg(
        F.array_sort(F.collect_list("event_id")).alias("ids"))
    total = F.col("_set") == 3
    return counted.select(
        F.when(total, "total").when(F.col("_set") == 1, "source_type").otherwise("severity").alias("dimension"),
        F.when(total, "all").otherwise(F.coalesce("source_type", "severity", F.lit("unknown"))).alias("value"),
        "accepted", "stored", "dropped", "failed", F.when(total, listed.scalar()).alias("ids"))
