"""Answers for analysts: digests, profiles, forensics, panels, inventories, counters.

The score tables read here are scored events: ``event_id, us, ts, user, source_ip,
namespace, object_type, method, hour, is_failed, is_sensitive, anomaly_score``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.functions.text import contains_any
from eventwarden.functions.timestamps import is_off_hours

SCORE_FLOORS = {"HIGH": 0.9, "MEDIUM": 0.6, "LOW": 0.0}


def _score() -> Column:
    return F.coalesce(F.col("anomaly_score"), F.lit(0.0))


# --- recent events and digests ----------------------------------------------

def recent_events(scored: DataFrame, limit: int = 200, level: str | None = None) -> DataFrame:
    """Newest events, optionally at or above the floor of a level (no upper bound)."""
    if level:
        scored = scored.where(F.col("anomaly_score") >= SCORE_FLOORS.get(level.upper(), 0.0))
    return scored.orderBy(F.col("us").desc(), F.col("event_id").desc()).limit(limit)


def last_hours(scored: DataFrame, hours: int = 24) -> DataFrame:
    """Events of the last hours of the data, whatever the clock says."""
    edge = scored.agg(F.max("us").alias("_v")).scalar() - hours * K.HOUR_US
    return scored.where(F.col("us") >= edge)


def digest(scored: DataFrame) -> DataFrame:
    """One row of totals; the risk classes are disjoint."""
    high, medium = K.LIVE_RISK
    return scored.agg(
        F.count("*").alias("total_events"),
        F.countDistinct("user").alias("unique_actors"),
        F.count_if(_score() > high).alias("high_risk"),
        F.count_if((_score() > medium) & (_score() <= high)).alias("medium_risk"),
        F.count_if(_score() <= medium).alias("low_risk"),
    )


def top_anomalies(scored: DataFrame, limit: int = 10, above: float = 0.5) -> DataFrame:
    return scored.where(_score() > above).orderBy(
        F.col("anomaly_score").desc(), F.col("us").desc(), F.col("event_id").desc()).limit(limit)


def behaviour_flags(scored: DataFrame, limit: int | None = 5) -> DataFrame:
    """Users active off hours who also have high scores."""
    found = scored.groupBy("user").agg(
        F.count_if(is_off_hours(F.col("hour"))).alias("off_hours_events"),
        F.count_if(_score() > K.TRAINING_RISK[0]).alias("high_risk_events"),
    ).where((F.col("off_hours_events") > 0) & (F.col("high_risk_events") > 0))
    if limit is None:
        return found
    return found.orderBy(F.col("high_risk_events").desc(), "user").limit(limit)


# --- behaviour profile ------------------------------------------------------

def behaviour_profile(scored: DataFrame) -> DataFrame:
    """One row of numbers per user.

    The most active hour is the earliest among equals.
    """
    high, medium = K.TRAINING_RISK
    totals = scored.groupBy("user").agg(
        F.count("*").alias("total_events"),
        F.min("us").alias("first_seen_us"), F.max("us").alias("last_seen_us"),
        F.countDistinct("namespace").alias("unique_namespaces"),
        F.countDistinct("object_type").alias("unique_object_types"),
        F.countDistinct("source_ip").alias("unique_source_ips"),
        F.sum("is_failed").alias("failed_requests"),
        F.sum("is_sensitive").alias("sensitive_accesses"),
        F.count_if(is_off_hours(F.col("hour"))).alias("off_hours_events"),
        F.count_if(_score() > high).alias("high_risk_events"),
        F.count_if((_score() > medium) & (_score() <= high)).alias("medium_risk_events"),
    )
    hours = scored.groupBy("user", "hour").agg(F.count("*").alias("_n"))
    busiest = hours.groupBy("user").agg(
        F.max_by("hour", F.struct(F.col("_n"), -F.col("hour"))).alias("most_active_hour"))
    return totals.join(busiest, "user").withColumns({
        "failure_rate_pct": F.bround(F.col("failed_requests") / F.col("total_events") * 100, 1),
        "sensitive_rate_pct": F.bround(F.col("sensitive_accesses") / F.col("total_events") * 100, 1),
    })


def profile_values(scored: DataFrame) -> DataFrame:
    """The lists behind a profile, one row per user, kind and value, with counts.

    Rows instead of nested sets: a user with very many values stays distributed.
    """
    kinds = {"method": "method", "namespace": "namespace", "object_type": "object_type",
             "source_ip": "source_ip", "hour": "hour"}
    tall = scored.select("user", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
        for kind, c in kinds.items()])))
    return tall.where(F.coalesce("value", F.lit("")) != "").groupBy("user", "kind", "value").agg(
        F.count("*").alias("events"))


def profile_examples(scored: DataFrame, off_hours: int = 3, high: int = 5) -> DataFrame:
    """First off-hours events and last high-score events of each user.

    The rank limits apply before the shuffle, so a busy user sends few rows.
    """
    early = Window.partitionBy("user").orderBy("us", "event_id")
    late = Window.partitionBy("user").orderBy(F.col("us").desc(), F.col("event_id").desc())
    first = scored.where(is_off_hours(F.col("hour"))).withColumn(
        "place", F.row_number().over(early)).where(F.col("place") <= off_hours)
    last = scored.where(_score() > K.TRAINING_RISK[0]).withColumn(
        "place", F.row_number().over(late)).where(F.col("place") <= high)
    return first.withColumn("example", F.lit("off hours")).unionByName(
        last.withColumn("example", F.lit("high score"))).select(
        "user", "example", "place", "event_id", "us", "namespace", "object_type", "method", "anomaly_score")


# --- forensics --------------------------------------------------------------

FORENSIC_COLUMNS = ("event_id", "us", "user", "source_ip", "namespace", "object_type", "method",
                    "is_failed", "is_sensitive", "anomaly_score")


def forensic_filter(intent: Mapping[str, object]) -> Column:
    """Predicate of an intent record; absent parts do not restrict."""
    keep = F.lit(True)
    for name in ("user", "namespace", "object_type"):
        if intent.get(name):
            keep = keep & F.contains(F.lower(F.col(name)), F.lit(str(intent[name]).lower()))
    if intent.get("method"):
        keep = keep & (F.col("method") == str(intent["method"]).lower())
    if intent.get("start"):
        keep = keep & (F.col("ts") >= F.lit(str(intent["start"])).cast("timestamp"))
    if intent.get("end"):
        keep = keep & (F.col("ts") <= F.lit(str(intent["end"])).cast("timestamp"))
    if intent.get("is_failed") is not None:
        keep = keep & (F.col("is_failed") == int(intent["is_failed"]))
    if intent.get("min_score") is not None:
        keep = keep & (F.col("anomaly_score") >= float(intent["min_score"]))
    return keep


def forensics(scored: DataFrame, intent: Mapping[str, object]) -> DataFrame:
    """Matching events by score; if there is none, the newest of the high scores."""
    order = [F.col("anomaly_score").desc_nulls_last(), F.col("us").desc(), F.col("event_id").desc()]
    found = scored.where(forensic_filter(intent)).orderBy(*order).limit(int(intent.get("limit") or 30))
    if not found.isEmpty():
        return found.select(*FORENSIC_COLUMNS)
    return (
        scored.where(F.col("anomaly_score") >= 0.8)
        .orderBy(F.col("us").desc(), F.col("event_id").desc()).limit(50).select(*FORENSIC_COLUMNS)
    )


def actor_rbac_history(scored: DataFrame, last: int = 5) -> DataFrame:
    """The last events of each user on permission resources."""
    newest = Window.partitionBy("user").orderBy(F.col("us").desc(), F.col("event_id").desc())
    rows = scored.where(contains_any(F.col("object_type"), K.RBAC_WORDS))
    return rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= last)


# --- labels -----------------------------------------------------------------

def with_labels(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Scored events with the newest analyst label given to each."""
    newest = labels.groupBy("event_id").agg(F.max_by("label", "labelled_at").alias("analyst_label"))
    return scored.drop("analyst_label").join(newest, "event_id", "left")


def label_counts(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("total"), F.count("analyst_label").alias("labeled"),
        F.count_if(F.col("analyst_label") == 1).alias("confirmed_anomalies"))


# --- counters and panels ----------------------------------------------------

def ingest_counters(events: DataFrame) -> DataFrame:
    """Processed events by source and by severity: ``(dimension, value, events)``."""
    from eventwarden.functions.rules import counter_severity

    grouped = events.withColumn("severity", counter_severity(F.col("severity"))).groupingSets(
        [[F.col("source_type")], [F.col("severity")], []],
        F.col("source_type"), F.col("severity")).agg(
        F.count("*").alias("events"), F.grouping_id().alias("_set"))
    return grouped.select(
        F.when(F.col("_set") == 1, "source_type").when(F.col("_set") == 2, "severity")
        .otherwise("total").alias("dimension"),
        F.coalesce("source_type", "severity", F.lit("all")).alias("value"), "events")


def ingest_summary(outcomes: DataFrame, parity: bool = False) -> DataFrame:
    """Accepted, stored, dropped and failed items of a batch.

    ``outcomes`` has ``outcome`` in stored/dropped/failed. The three are disjoint;
    with ``parity`` a dropped item also counts as failed.
    """
    failed = F.col("outcome").isin("failed", "dropped") if parity else F.col("outcome") == "failed"
    return outcomes.agg(
        F.count("*").alias("accepted"), F.count_if(F.col("outcome") == "stored").alias("stored"),
        F.count_if(F.col("outcome") == "dropped").alias("dropped"), F.count_if(failed).alias("failed"))


def breakdown(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("events"))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, and its share of all rows."""
    counted = breakdown(rows, column)
    # One row per value: the total is a sum over few rows.
    total = F.sum("events").over(Window.partitionBy(F.lit(0)))
    return counted.withColumn("share", F.col("events") / total)


def top_k(rows: DataFrame, k: int, *columns: str) -> DataFrame:
    """The k most frequent values; equals in value order."""
    return breakdown(rows, *columns).orderBy(F.col("events").desc(), *columns).limit(k)


def over_time(rows: DataFrame, *columns: str, width: str = "5 minutes", step: str | None = None,
              ts: str = "ts") -> DataFrame:
    """Counts per time window; ``step`` smaller than ``width`` makes it slide."""
    slot = F.window(ts, width, step) if step else F.window(ts, width)
    return rows.groupBy(slot.alias("_slot"), *columns).agg(F.count("*").alias("events")).select(
        F.unix_micros("_slot.start").alias("start_us"), *columns, "events")


CRITICAL_PRIORITIES = r"(?i)^(Critical|Emergency|Alert)$"
NOTICE_PRIORITIES = r"(?i)^(Notice|Info|Informational|Debug)$"
URGENT_PRIORITIES = r"^(Critical|Warning|Emergency|Alert)$"


def priority_panel(alerts: DataFrame, yellow: int = 5, red: int = 20) -> DataFrame:
    """Totals of runtime alerts and the traffic light of the urgent ones."""
    totals = alerts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("priority").rlike(CRITICAL_PRIORITIES)).alias("critical"),
        F.count_if(F.col("priority").rlike(NOTICE_PRIORITIES)).alias("notice"),
        F.count_if(F.col("priority").rlike(URGENT_PRIORITIES)).alias("urgent"))
    light = F.when(F.col("urgent") >= red, "red").when(F.col("urgent") >= yellow, "yellow").otherwise("green")
    return totals.withColumn("light", light)


def distinct_sorted(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct().orderBy(column)


def select_equal(rows: DataFrame, column: str, value: str = "all") -> DataFrame:
    return rows if value == "all" else rows.where(F.col(column) == value)


def state_counts(rows: DataFrame, column: str, states: Mapping[str, str]) -> DataFrame:
    """One row: a count per state, and all rows."""
    return rows.agg(F.count("*").alias("total"), *[
        F.count_if(F.col(column) == value).alias(name) for name, value in states.items()])


# --- inventory --------------------------------------------------------------

def pods_by_namespace(pods: DataFrame) -> DataFrame:
    """Pods in namespace order, with the size of their namespace."""
    rows = pods.withColumn("namespace", F.coalesce("namespace", F.lit("default")))
    sizes = rows.groupBy("namespace").agg(F.count("*").alias("pods_in_namespace"))
    return rows.join(sizes, "namespace")


def cluster_tree(nodes: DataFrame, pods: DataFrame) -> DataFrame:
    """Nodes with namespaces and pods as ordered rows.

    Nodes without pods stay, pods of unknown nodes stay, unscheduled pods form a
    pseudo node that exists only when it has pods. ``node_rank`` puts the control
    plane first, then the workers, then the unscheduled.
    """
    placed = pods.select(
        F.coalesce("node", F.lit("_unscheduled_")).alias("node"),
        F.coalesce("namespace", F.lit("default")).alias("namespace"),
        F.col("name").alias("pod"), F.coalesce("app", F.lit("")).alias("app"),
        F.coalesce("phase", F.lit("Unknown")).alias("phase"))
    named = nodes.select(F.col("name").alias("node"), "role")
    # Two joins instead of a full one: a left join can split a node with very many pods.
    empty = named.join(placed.select("node").distinct(), "node", "left_anti")
    tree = placed.join(named, "node", "left").unionByName(empty, allowMissingColumns=True)
    waiting = F.col("node") == "_unscheduled_"
    role = F.when(waiting, "pending").otherwise(F.coalesce("role", F.lit("unknown")))
    return tree.select(
        F.when(role == "control-plane", 0).when(role == "pending", 2).otherwise(1).alias("node_rank"),
        F.when(waiting, "(unscheduled)").otherwise(F.col("node")).alias("node"),
        role.alias("role"), "namespace", "pod", "app", "phase")


def in_tree_order(tree: DataFrame) -> DataFrame:
    return tree.orderBy("node_rank", "node", "namespace", "pod")


def services_by_namespace(services: DataFrame) -> DataFrame:
    rows = services.select(F.coalesce("namespace", F.lit("default")).alias("namespace"), "name",
                           F.coalesce("type", F.lit("ClusterIP")).alias("type"))
    return rows.where(~((F.col("namespace") == "default") & (F.col("name") == "kubernetes")))
