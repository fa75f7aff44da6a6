"""Detections for documented investigations.

Each works on scorer-shaped events: ``event_id, us, user, source_ip, namespace,
object_type, method, is_failed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.functions.text import contains_any
from eventwarden.operators.ordered import DEFAULT_POLICY, SlicePolicy
from eventwarden.operators.rolling import RollingPlan, RollingSum, first_sightings, with_rolling

SERVICE_ACTOR = r"^system:|serviceaccount|bot"


def day_of(us: Column) -> Column:
    return F.floor(us / K.DAY_US).cast("bigint")


def daily_summary(events: DataFrame) -> DataFrame:
    """Per day: events, service and human actors, failures."""
    service = F.col("user").rlike(SERVICE_ACTOR)
    return events.groupBy(day_of(F.col("us")).alias("day")).agg(
        F.count("*").alias("events"),
        F.countDistinct("user").alias("actors"),
        F.countDistinct(F.when(service, F.col("user"))).alias("service_actors"),
        F.countDistinct(F.when(~service, F.col("user"))).alias("human_actors"),
        F.sum("is_failed").alias("failed"),
    )


def read_bursts(events: DataFrame, words: Sequence[str] = ("secret",), minutes: int = 5,
                factor: int = 10, floor: int = 2, baseline_days: int = 7) -> DataFrame:
    """Short windows with far more reads than the actor's trailing daily mean.

    Both counts are combined per window and per day before anything is ordered.
    """
    reads = events.where(contains_any(F.col("object_type"), words)
                         & F.col("method").isin("get", "list", "watch"))
    width = minutes * K.MINUTE_US
    slots = reads.groupBy("user", F.floor(F.col("us") / width).alias("slot")).agg(F.count("*").alias("calls"))
    days = slots.groupBy("user", F.floor(F.col("slot") * width / K.DAY_US).alias("day")).agg(
        F.sum("calls").alias("_day_calls"))
    before = Window.partitionBy("user").orderBy("day").rangeBetween(-baseline_days, -1)
    days = days.withColumn("baseline_calls", F.coalesce(F.sum("_day_calls").over(before), F.lit(0)))
    joined = slots.withColumn("day", F.floor(F.col("slot") * width / K.DAY_US)).join(
        days.select("user", "day", "baseline_calls"), ["user", "day"])
    burst = (F.col("calls") >= floor) & (F.col("calls") * baseline_days > F.col("baseline_calls") * factor)
    return joined.where(burst).select("user", (F.col("slot") * width).alias("start_us"), "calls", "baseline_calls")


def session_bursts(events: DataFrame, gap_us: int = 5 * K.MINUTE_US, floor: int = 2) -> DataFrame:
    """Runs of an actor's events in which every pause is shorter than the gap.

    Events within one gap-wide slice always belong together, so they are combined
    first; only slices are ordered, and their number is bounded by time.
    """
    slices = events.groupBy("user", F.floor(F.col("us") / gap_us).alias("_slice")).agg(
        F.min("us").alias("_first"), F.max("us").alias("_last"), F.count("*").alias("_n"))
    by_time = Window.partitionBy("user").orderBy("_slice")
    starts = F.coalesce(F.col("_first") - F.lag("_last").over(by_time) >= gap_us, F.lit(True))
    runs = slices.withColumn("_start", starts.cast("int")).withColumn(
        "_run", F.sum("_start").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user", "_run").agg(
        F.min("_first").alias("start_us"), (F.max("_last") + gap_us).alias("end_us"),
        F.sum("_n").alias("events")).where(F.col("events") >= floor).drop("_run")


def outside_change_window(events: DataFrame, start_hour: int = 8, end_hour: int = 18) -> DataFrame:
    """Permission changes at an hour outside the approved window."""
    grants = contains_any(F.col("object_type"), ("role",)) & F.col("method").isin(*K.WRITE_VERBS)
    return events.where(grants & ((F.col("hour") < start_hour) | (F.col("hour") >= end_hour)))


def repeated_exec(events: DataFrame, times: int = 3, hours: int = 2,
                  policy: SlicePolicy = DEFAULT_POLICY) -> DataFrame:
    """Exec calls that are at least the n-th by an actor on one target in some hours.

    ``target`` names the pod or workload.
    """
    rows = events.where(F.col("object_type").endswith("/exec")).select(
        "event_id", "us", "user", "namespace", "target",
        F.concat_ws("|", "user", "namespace", "target").alias("_pair"))
    plan = RollingPlan("_pair", (RollingSum("_before", hours * K.HOUR_US),))
    return with_rolling(rows, plan, policy=policy).where(F.col("_before") + 1 >= times).select(
        "event_id", "us", "user", "namespace", "target", (F.col("_before") + 1).alias("calls"))


def first_permission_change(events: DataFrame, days: int = 180) -> DataFrame:
    """Permission changes of an actor with none in the days before."""
    rows = events.where(contains_any(F.col("object_type"), ("role",)) & F.col("method").isin(*K.WRITE_VERBS))
    return first_sightings(rows, ["user"], "us", days * K.DAY_US)


def first_secret_access(events: DataFrame, days: int = 90) -> DataFrame:
    """Accesses to a secret, by any verb, by an actor with none in the days before."""
    rows = events.where(contains_any(F.col("object_type"), ("secret",)))
    return first_sightings(rows, ["user", "namespace", "target"], "us", days * K.DAY_US)


def workload_drift(approved: DataFrame, observed: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields in which observed workloads differ from the approved ones.

    Workloads on one side only differ in every field they set.
    """
    left = approved.select(key, *[F.col(f).cast("string").alias("_a_" + f) for f in fields])
    right = observed.select(key, *[F.col(f).cast("string").alias("_o_" + f) for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col("_a_" + f).alias("approved"),
                               F.col("_o_" + f).alias("observed")) for f in fields])
    differing = F.filter(pairs, lambda p: ~p["approved"].eqNullSafe(p["observed"]))
    return left.join(right, key, "full_outer").select(key, F.inline(differing))


def denial_spikes(events: DataFrame, minutes: int = 60, floor: int = 2, z_limit: float = 3.0) -> DataFrame:
    """Windows in which an address gets far more denials than in its windows before.

    The deviation comes from whole sums, so it does not depend on the order of rows.
    """
    width = minutes * K.MINUTE_US
    slots = events.where(F.col("status_code").isin(*K.AUTH_DENIED_CODES)).groupBy(
        "source_ip", F.floor(F.col("us") / width).alias("slot")).agg(F.count("*").alias("denials"))
    earlier = Window.partitionBy("source_ip").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = slots.withColumns({
        "_n": F.count("*").over(earlier),
        "_s": F.sum("denials").over(earlier),
        "_q": F.sum(F.col("denials") * F.col("denials")).over(earlier),
    })
    mean = F.col("_s") / F.col("_n")
    variance = F.col("_q") / F.col("_n") - mean * mean
    z = F.when((F.col("_n") > 0) & (variance > 0), (F.col("denials") - mean) / F.sqrt(variance))
    return rows.withColumn("z", F.round(z, 6)).where(
        (F.col("denials") >= floor) & (F.col("z").isNull() | (F.col("z") > z_limit))).select(
        "source_ip", (F.col("slot") * width).alias("start_us"), "denials", "z")


def unfamiliar_agents(events: DataFrame) -> DataFrame:
    """First use of a user agent by an actor who already used another one."""
    agents = events.groupBy("user", "user_agent").agg(F.min("us").alias("first_us"))
    known = events.groupBy("user").agg(F.min("us").alias("_start"))
    return agents.join(known, "user").where(F.col("first_us") > F.col("_start")).drop("_start")
