"""One query per job and operator, over the test tables, whole."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.adapter import normalized, raw_items, scorer_events, security_rows, table
from eventwarden.functions import rules as R
from eventwarden.functions.hashing import hash_bucket, hash_bucket_once
from eventwarden.functions.text import slug
from eventwarden.functions.timestamps import iso_text
from eventwarden.models.drift import auc, binary_report, psi, replace_decision
from eventwarden.models.forest import (
    Forest, fit_forest, load_forest, normalized as normalized_score, raw_score, score_stats,
)
from eventwarden.models.score_days import drift_by_day, score_days
from eventwarden.models.sequence import (
    fit_sequence, held_out, label_join, padded, recent_window, sequence_score, sequence_windows,
    step_scale, time_split, window_tasks,
)
from eventwarden.operators import dedup, policy, runtime, validate
from eventwarden.operators.normalize import (
    forward_audit, from_app_containers, from_runtime_pods, normalize_events,
    outside_system_namespaces, parse_access_lines, parse_sensor_lines, quarantine,
)
from eventwarden.operators.ordered import SlicePolicy
from eventwarden.operators.tagging import tag_events
from eventwarden.plans import analytics as A
from eventwarden.plans import usecases as U
from eventwarden.plans.features import (
    HISTORY_INPUT, feature_matrix, reason_text, rolling_features, with_ip_history, with_user_history,
)
from eventwarden.plans.ingest import complete_input, failures, ingest, ingest_report, outcomes, scorer_input
from eventwarden.plans.scoring import ForestModel, combined_score, score_events, select_alerts
from eventwarden.session import cut_lineage, drop_copies, prepare, shuffles_end, spread
from eventwarden.sources import writers
from eventwarden.sources.writers import kafka_rows

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(job: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return job(prepare(spark), folder)
    _REGISTRY[job.__name__] = run
    return job


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def us(column: str) -> Column:
    return F.unix_micros(column)


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return security_rows(spark, folder).where("source_type = 'falco'")


def audits(spark: SparkSession, folder: str) -> DataFrame:
    return security_rows(spark, folder).where("source_type = 'k8s_audit'")


# --- ingest -----------------------------------------------------------------

def _timed_items(spark: SparkSession, folder: str) -> DataFrame:
    """Log items whose times are epoch seconds, milliseconds, text or no time at all; some are cut off."""
    micros = us(F.col("ts").cast("timestamp"))
    stamp = F.expr("event_id % 4")
    when = F.when(stamp == 0, F.floor(micros / 1_000_000).cast("string")).when(
        stamp == 1, F.floor(micros / 1000).cast("string")).when(
        stamp == 2, F.concat(F.lit('"'), iso_text(F.col("ts").cast("timestamp")), F.lit('"'))).otherwise('"soon"')
    end = F.when(F.col("event_id") % 7 == 0, "").otherwise("}")
    body = F.concat(F.lit('{"event_id":"'), F.col("event_id").cast("string"), F.lit('","message":"m","timestamp":'), when, end)
    return table(spark, folder, "events").select(F.lit("app").alias("source_type"), body.alias("body"))


@query
def epoch_times(spark, folder):
    return normalize_events(_timed_items(spark, folder)).select(
        F.col("event_id").cast("bigint").alias("event_id"), us("timestamp").alias("us"))


@query
def quarantined_items(spark, folder):
    return quarantine(_timed_items(spark, folder))


@query
def normalized_events(spark, folder):
    return normalized(spark, folder).select(
        "event_id", us("timestamp").alias("us"), us("completion_time").alias("completed_us"),
        "source_type", "service_name", "namespace", "pod_name", "user_name", "effective_user",
        "is_impersonated", "severity", "event_type", "message", "classification",
        "security_relevant", "action", "resource", "subresource", "resource_name", "api_group",
        "status_code", "derived_privileges")


@query
def classification_breakdown(spark, folder):
    return A.breakdown(normalized(spark, folder), "source_type", "classification")


@query
def ingest_counters(spark, folder):
    return A.ingest_counters(normalized(spark, folder))


@query
def ingest_summary(spark, folder):
    return A.ingest_summary(outcomes(raw_items(spark, folder)))


@query
def ingest_summary_parity(spark, folder):
    return A.ingest_summary(outcomes(raw_items(spark, folder)), parity=True)


@query
def batch_report(spark, folder):
    """What became of all items, broken ones among them, as the ingest stream reports every batch."""
    found = outcomes(raw_items(spark, folder)).unionByName(failures(_timed_items(spark, folder)))
    return ingest_report(found).withColumn("ids", F.array_join("ids", ","))


@query
def stored_events(spark, folder):
    return ingest(raw_items(spark, folder)).select("event_id", "source_type", "namespace", "classification")


@query
def audit_policy_level(spark, folder):
    decision = policy.audit_policy(F.col("action"), F.col("api_group"), F.col("resource"),
                                   F.col("subresource"), F.col("user_groups"))
    rows = normalized(spark, folder).where("source_type = 'k8s_audit'").withColumn("_p", decision)
    return rows.select("event_id", F.col("_p.level").alias("level"),
                       F.array_contains("_p.stages", "ResponseStarted").alias("records_started"))


@query
def noise_filters(spark, folder):
    rows = normalized(spark, folder).where("source_type = 'k8s_audit'")
    reason = policy.noise_reason(F.col("action"), F.col("resource"), F.col("subresource"),
                                 F.col("request_uri"), F.col("user_name"))
    return rows.select("event_id", reason.alias("reason"))


@query
def namespace_policy(spark, folder):
    inputs = [F.col(c) for c in ("source_type", "namespace", "status_code", "classification")]
    return normalized(spark, folder).select(
        "event_id", policy.is_kept(*inputs).alias("kept_by_default"),
        policy.is_kept(*inputs, allowed=["prod", "kube-system"]).alias("kept_by_allowlist"))


@query
def tags_exploded(spark, folder):
    return tag_events(normalized(spark, folder)).select(
        "event_id", F.posexplode("tags").alias("pos", "tag"))


@query
def field_retention(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("event_id"), F.lit("x").alias("dropped"), F.col("source").alias("message"),
        F.col("text").alias("raw_event"))
    shaped = policy.shape_fields(docs, keep=["raw_event"], max_bytes=4000)
    trimmed = F.get_json_object("raw_event", "$._bytes").cast("bigint")
    return shaped.select("event_id", "message", trimmed.alias("trimmed_bytes"),
                         F.when(trimmed.isNull(), F.length("raw_event")).alias("chars_kept"))


@query
def forwarded_audit(spark, folder):
    lines = raw_items(spark, folder).where("source_type = 'k8s_audit'").select(F.col("body").alias("value"))
    sent = forward_audit(kafka_rows(forward_audit(lines), wrapped=False))
    return normalize_events(sent).select("event_id", "classification", "request_uri", "user_name")


@query
def sensor_lines(spark, folder):
    lines = raw_items(spark, folder).where("source_type = 'falco'").select(
        "event_no", F.col("body").alias("message"), F.concat(
            F.when(F.col("event_no") % 4 == 0, "falco-falcosidekick-").otherwise("falco-"),
            F.col("event_no").cast("string")).alias("pod_name"))
    rows = parse_sensor_lines(from_runtime_pods(lines))
    return rows.select(F.col("event_no").alias("event_id"), F.col("labels")["rule"].alias("rule"),
                       F.col("labels")["priority"].alias("priority"))


@query
def container_lines(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.concat(
        F.col("source"), F.when(F.col("doc_id") % 3 == 0, "-order-service-1")
        .when(F.col("doc_id") % 3 == 1, "-user-service").otherwise("-proxy")).alias("container_name"),
        F.concat(F.lit("/var/log/pods/"), F.when(F.col("doc_id") % 5 == 0, "kube-system").otherwise("shop"),
                 F.lit("/x.log")).alias("path"))
    return outside_system_namespaces(from_app_containers(docs)).select("doc_id", "container_name")


@query
def completed_inputs(spark, folder):
    rows = security_rows(spark, folder).select(
        "event_id", "ts", F.col("fd_name").alias("source_ip"), F.col("namespace"),
        F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("verb")).alias("method"),
        F.when(F.col("status_code") >= 400, "Failure").alias("result"))
    return complete_input(rows).select("event_id", "source_ip", "namespace", "method", "result", "user", "is_failed")


@query
def scored_documents(spark, folder):
    rows = scorer_events(spark, folder).withColumns({
        "if_score": F.col("anomaly_score"), "seq_score": F.col("previous_score"), "seq_active": F.lit(True),
        "risk_level": R.risk_level(F.col("anomaly_score")), "reason": F.lit("r"), "model_version": F.lit("v1")})
    docs = writers.scored_documents(rows, F.when(F.col("event_type") == "falco", "falco-alerts").otherwise("k8s-audit-raw"))
    return docs.select("source_topic", "user", "object_type", "risk_level", F.col("ml_output.if_score").alias("if_score"),
                       us("ml_input.ts").alias("us"), F.date_format("event_date", "yyyy-MM-dd").alias("day"))


@query
def retention_window(spark, folder):
    rows = normalized(spark, folder)
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return policy.within_retention(rows, 7.5, now).select("event_id", us("timestamp").alias("us"))


@query
def log_level_from_text(spark, folder):
    docs = spread(table(spark, folder, "documents"), "doc_id").withColumns({
        "message": F.col("text"), "container_name": F.col("source"),
        "container_id": F.col("doc_id").cast("string")})
    events = normalize_events(parse_access_lines(docs))
    return events.select(F.col("pod_name").cast("bigint").alias("doc_id"), "service_name", "severity",
                         "classification", "event_type", F.length("message").alias("chars"))


@query
def slug_of_text(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", R.falco_classification(F.col("text")).alias("classification"),
        slug(F.col("text"), "alert", "-").alias("dashed"))


@query
def fingerprint_dedup(spark, folder):
    events = normalized(spark, folder)
    again = events.withColumn("ingest_ts", F.col("ingest_ts") + F.expr("INTERVAL 1 HOUR"))
    return dedup.last_version(events.unionByName(again)).select(
        "event_id", us("ingest_ts").alias("ingest_us"))


@query
def noisy_throttle(spark, folder):
    rows = alerts(spark, folder).select(
        "event_id", us("ts").alias("us"), R.falco_classification(F.col("rule")).alias("classification"))
    # A gap of hours instead of 30 seconds: the test events are minutes apart.
    return dedup.throttle(rows, gap_us=6 * K.HOUR_US)


@query
def scorer_inputs(spark, folder):
    return scorer_input(raw_items(spark, folder)).select(
        F.col("event_no").alias("event_id"), us("ts").alias("us"), "user", "method", "object_type",
        "namespace", "source_ip", "result", "object_name", "event_type", "classification",
        "requesting_service", "is_failed")


# --- runtime rows -----------------------------------------------------------

@query
def runtime_actions(spark, folder):
    rows = runtime.with_runtime_columns(normalized(spark, folder)).where("kind <> 'audit'")
    return rows.select("event_id", "kind", "command", "runtime_action", "runtime_detail", "workload",
                       runtime.action_priority(F.col("runtime_action"), F.col("severity")).alias("priority"))


@query
def monitor_records(spark, folder):
    d = F.col("data")
    return runtime.monitor_events(normalized(spark, folder)).select(
        "id", "type", us("time").alias("time_us"), "securityRelevant",
        d["source"]["subject"].alias("subject"), d["source"]["requestRoles"].alias("roles"),
        d["source"]["requestMethod"].alias("request_method"), d["source"]["requestUrl"].alias("request_url"),
        d["destination"]["requestedCall"].alias("requested_call"),
        d["destination"]["destinationPort"].alias("destination_port"),
        d["network"]["apiCallResult"].alias("call_result"),
        d["network"]["classification"].alias("classification"),
        d["object"]["objname"].alias("objname"), d["object"]["objtype"].alias("objtype"),
        us("data.object.objdeletetime").alias("deleted_us"))


@query
def alert_stream(spark, folder):
    rows = runtime.alert_streams(normalized(spark, folder))
    return rows.select(F.get_json_object("line", "$.event_id").alias("event_id"), "ts_ns",
                       F.col("labels")["rule"].alias("rule"), F.col("labels")["priority"].alias("priority"),
                       F.get_json_object("line", "$.time").alias("time"))


@query
def exec_command(spark, folder):
    # The pages' queries stand in for request lines; exec URIs come from the events.
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("p-"), F.col("page_id").cast("string")).alias("id"),
        F.concat(F.lit("/exec?"), F.replace(F.replace(F.split_part("url", F.lit("?"), F.lit(2)), F.lit("page="), F.lit("command=")),
                                            F.lit("ref="), F.lit("command="))).alias("uri"))
    uris = audits(spark, folder).select(
        F.concat(F.lit("a-"), F.col("event_id").cast("string")).alias("id"), "uri")
    none = F.lit(None).cast("string")
    return pages.unionByName(uris).select("id", runtime.exec_command(F.col("uri"), none, none).alias("command"))


# --- features ---------------------------------------------------------------

@query
def feature_hash(spark, folder):
    rows = scorer_events(spark, folder)
    return rows.select("event_id", *[
        hash_bucket(F.col(c), n).alias(c + "_hash") for c, n in K.HASH_BUCKETS.items()])


@query
def event_flags(spark, folder):
    return scorer_events(spark, folder).select(
        "event_id", "hour", "day_of_week", "is_off_hours", "is_sensitive", "is_failed",
        "is_high_risk", "is_rbac")


def _user_rows(spark, folder):
    events = scorer_events(spark, folder)
    return with_user_history(events.select(*HISTORY_INPUT), digits=None)


@query
def user_rolling_counts(spark, folder):
    return _user_rows(spark, folder).select("event_id", "req_24h", "req_7d", "req_30d", "is_new_user")


@query
def user_rolling_rates(spark, folder):
    return _user_rows(spark, folder).select("event_id", "fail_ratio_7d", "sensitive_rate_7d")


@query
def user_rolling_distinct(spark, folder):
    return _user_rows(spark, folder).select("event_id", "unique_namespaces", "unique_resources", "unique_ips")


@query
def user_hour_baseline(spark, folder):
    return _user_rows(spark, folder).select("event_id", "user_hour_baseline")


@query
def ip_rolling(spark, folder):
    events = scorer_events(spark, folder)
    return with_ip_history(events.select(*HISTORY_INPUT), digits=None).select(
        "event_id", "ip_req_24h", "ip_fail_ratio_24h", "ip_unique_users", "is_new_ip", "fail_burst_5min")


@query
def hot_user_rolling(spark, folder):
    """A third of all events belong to one user, and that user is cut into slices."""
    events = scorer_events(spark, folder).withColumn(
        "user", F.when(F.col("event_id") % 3 == 0, "system:hot").otherwise(F.col("user")))
    cut = SlicePolicy(min_rows=1000, target_rows=500)
    return with_user_history(events.select(*HISTORY_INPUT), policy=cut, digits=None).select(
        "event_id", "req_24h", "req_7d", "req_30d", "fail_ratio_7d", "sensitive_rate_7d", "user_hour_baseline",
        "is_new_user", "unique_namespaces", "unique_resources", "unique_ips")


@query
def reasons(spark, folder):
    rows = rolling_features(scorer_events(spark, folder), digits=None)
    return rows.select("event_id", reason_text().alias("reason"))


@query
def feature_rows(spark, folder):
    """The whole feature matrix."""
    return feature_matrix(scorer_events(spark, folder)).select("event_id", *K.FEATURE_COLS)


# --- scores -----------------------------------------------------------------

@query
def risk_levels(spark, folder):
    return scorer_events(spark, folder).select(
        "event_id", R.risk_level(F.col("anomaly_score")).alias("live"),
        R.risk_level(F.col("anomaly_score"), K.TRAINING_RISK).alias("training"))


@query
def critical_alerts(spark, folder):
    rows = security_rows(spark, folder)
    method = F.when(F.col("source_type") == "falco", F.col("rule")).otherwise(F.col("verb"))
    target = F.when(F.col("source_type") == "falco", "runtime_event").otherwise(
        F.concat_ws("/", "resource", "subresource"))
    risk = R.risk_level(F.col("anomaly_score"))
    keep = R.is_critical_alert(risk, F.col("anomaly_score"), F.col("source_type"), method, target, F.lit(""))
    return rows.where(keep).select("event_id", "source_type", method.alias("method"), "anomaly_score")


@query
def human_workload_changes(spark, folder):
    return scorer_events(spark, folder).where(R.is_human_workload_change(
        F.col("user"), F.col("object_type"), F.col("method"))).select("event_id", "user", "object_type", "method")


@query
def combined_scores(spark, folder):
    rows = scorer_events(spark, folder)
    active = F.col("event_id") % 3 != 0
    return rows.select("event_id", combined_score(
        F.col("anomaly_score"), F.col("previous_score"), active).alias("combined"))


@query
def training_score_stats(spark, folder):
    return score_stats(table(spark, folder, "events"), "value").select(
        "n", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
        *[F.round(c, 9).alias(c) for c in ("p90", "p95", "p99")])


@query
def normalized_scores(spark, folder):
    events = table(spark, folder, "events")
    facts = events.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    return events.select("event_id", normalized_score(F.col("value"), facts["low"], facts["high"]).alias("score"))


@query
def psi_drift(spark, folder):
    found = psi(scorer_events(spark, folder), "previous_score", "anomaly_score")
    return found.select("n_old", "n_new", F.round("psi", 9).alias("psi"))


@query
def score_day_counts(spark, folder):
    """The daily summaries, without their sketches."""
    days = score_days(scorer_events(spark, folder))
    return days.select("day", "n", "n_high", *[F.col("bins")[i].alias(f"b{i}") for i in range(K.PSI_BINS)])


@query
def drift_over_days(spark, folder):
    """Every day's scores against all days before it, from the daily summaries."""
    return drift_by_day(score_days(scorer_events(spark, folder))).select(
        "day", "n_before", "n", "rate", F.round("psi", 9).alias("psi"))


@query
def model_decision(spark, folder):
    found = replace_decision(scorer_events(spark, folder), "previous_score", "anomaly_score")
    return found.select("old_rate", "new_rate", F.round("psi", 9).alias("psi"), "psi_alert", "decision")


@query
def chronological_split(spark, folder):
    return time_split(scorer_events(spark, folder).select("event_id", "us"), K.TRAIN_SHARE)


@query
def holdout_split(spark, folder):
    rows = recent_window(scorer_events(spark, folder).select("event_id", "us"), days=20)
    return held_out(rows)


@query
def sequence_window_sums(spark, folder):
    rows = scorer_events(spark, folder).select("event_id", "user", "us", "is_failed", "hour")
    windows = sequence_windows(rows, ("hour", "is_failed"))
    total = F.aggregate("window", F.lit(0.0).cast("double"), lambda a, s: a + s[0])
    failed = F.aggregate("window", F.lit(0.0).cast("double"), lambda a, s: a + s[1])
    return windows.select(
        "event_id", F.size("window").alias("steps"), "seq_active", total.alias("hour_sum"),
        failed.alias("failed_sum"), F.size(padded(F.col("window"), 2)).alias("padded_steps"))


@query
def sequence_scale(spark, folder):
    """Mean and deviation of two features over all steps of all windows, padding included."""
    rows = scorer_events(spark, folder).select("event_id", "user", "us", "is_failed", "hour")
    means, deviations = step_scale(sequence_windows(rows, ("hour", "is_failed")), 2)
    return spark.createDataFrame(list(zip(("hour", "is_failed"), means, deviations)),
                                 "feature string, mean double, deviation double").select(
        "feature", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def _labels(rows: DataFrame) -> DataFrame:
    word = F.when(F.col("analyst_label") == 1, "anomaly").when(
        F.col("analyst_label") == 0, "normal").otherwise("real_unknown")
    return rows.select("user", "ts", word.alias("label"), F.col("event_id").alias("seq"))


@query
def labelled_events(spark, folder):
    rows = scorer_events(spark, folder)
    return label_join(rows.select("event_id", "user", "ts"), _labels(rows)).select("event_id", "label")


@query
def auc_roc(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return auc(docs, "n_chars", "quality")


@query
def quality_report(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    score = docs.withColumn("score", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)))
    return binary_report(score, "score", "quality")


#: A small forest: failed calls before noon and sensitive ones after it; users with few calls a week and failing ones.
SMALL_FOREST = Forest(
    np.array([[6, 10, 9], [14, 7, 16]], dtype=np.int32), np.array([[11.5, 0.5, 0.5], [20.5, 2.5, 0.05]]),
    np.array([[2.0, 3.5, 4.0, 6.0], [5.5, 3.0, 6.5, 4.25]]), K.FOREST_SAMPLE)
SMALL_RANGE = (-0.85, -0.65)


@query
def forest_walk(spark, folder):
    """Raw scores of all events in the small forest."""
    matrix = feature_matrix(scorer_events(spark, folder))
    return matrix.select("event_id", F.round(raw_score(spark, SMALL_FOREST), 9).alias("raw_score"))


@query
def scored_events(spark, folder):
    """All events scored with the small forest: scores, risk, reason and model version."""
    scored = score_events(feature_matrix(scorer_events(spark, folder)), ForestModel(SMALL_FOREST, *SMALL_RANGE, "small"))
    return scored.select("event_id", "anomaly_score", "if_score", "risk_level", "reason", "model_version")


@query
def alert_texts(spark, folder):
    """The texts of the alerts among the scored events."""
    rows = scorer_events(spark, folder).withColumns({
        "risk_level": R.risk_level(F.col("anomaly_score")),
        "reason": F.when(F.col("event_id") % 4 == 0, "Terminal opened").otherwise("request burst")})
    return select_alerts(rows).select("event_id", "alert_record", "alert_text")


@query
def forest_scores(spark, folder):
    """Fit on the feature matrix and score every event of it."""
    rows = feature_matrix(scorer_events(spark, folder), bucket=hash_bucket_once)
    matrix = cut_lineage(rows.select("event_id", *K.FEATURE_COLS))
    forest = load_forest(fit_forest(matrix))
    return spread(matrix, "event_id").select("event_id", raw_score(spark, forest).alias("raw_score"))


@query
def forest_scores_lineitem(spark, folder):
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = spread(table(spark, folder, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", *columns).withColumn(
        "row_id", F.xxhash64("l_orderkey", "l_linenumber", *columns))
    forest = load_forest(fit_forest(rows, "row_id", columns))
    return rows.select("l_orderkey", "l_linenumber", raw_score(spark, forest, columns).alias("raw_score"))


@query
def sequence_scores(spark, folder):
    """Fit the sequence model on the earliest events, split by time, and score all windows.

    The target is whether the event failed, so that flag is none of the features.
    """
    columns = [c for c in K.FEATURE_COLS if c != "feat_is_failed"]
    with shuffles_end(spark):
        # Only what windows are made of is moved and written.
        matrix = cut_lineage(feature_matrix(scorer_events(spark, folder)).select(
            "event_id", "user", "us", "is_failed", *[F.col(c).cast("float").alias(c) for c in columns]))
        windows = cut_lineage(sequence_windows(matrix, columns, tasks=window_tasks(matrix)).select(
            "event_id", "us", "is_failed", "window", "seq_active"))
        drop_copies(matrix)
        train = time_split(windows, K.TRAIN_SHARE).where("is_train").withColumn("target", F.col("is_failed"))
        model, means, deviations = fit_sequence(train, len(columns))
    return sequence_score(windows, model, means, deviations).select("event_id", "seq_active", "seq_score")


# --- analysts ---------------------------------------------------------------

@query
def recent_events(spark, folder):
    return A.recent_events(scorer_events(spark, folder)).select("event_id", "us", "user", "anomaly_score")


@query
def recent_high_events(spark, folder):
    return A.recent_events(scorer_events(spark, folder), 100, "HIGH").select("event_id", "us", "anomaly_score")


@query
def digest_all(spark, folder):
    return A.digest(scorer_events(spark, folder))


@query
def digest_24h(spark, folder):
    return A.digest(A.last_hours(scorer_events(spark, folder)))


@query
def digest_top(spark, folder):
    return A.top_anomalies(scorer_events(spark, folder)).select("event_id", "user", "anomaly_score")


@query
def behaviour_flags(spark, folder):
    return A.behaviour_flags(scorer_events(spark, folder), limit=None)


@query
def behaviour_profile(spark, folder):
    return A.behaviour_profile(scorer_events(spark, folder)).drop("failure_rate_pct", "sensitive_rate_pct")


@query
def profile_values(spark, folder):
    return A.profile_values(scorer_events(spark, folder))


@query
def profile_examples(spark, folder):
    return A.profile_examples(scorer_events(spark, folder))


@query
def forensics(spark, folder):
    intent = {"user": "USER-", "object_type": "secret", "start": "2024-01-05", "end": "2024-01-25",
              "is_failed": 0, "min_score": 0.3, "limit": 40}
    return A.forensics(scorer_events(spark, folder), intent)


@query
def forensics_fallback(spark, folder):
    return A.forensics(scorer_events(spark, folder), {"user": "nobody-here"})


@query
def actor_rbac_history(spark, folder):
    return A.actor_rbac_history(scorer_events(spark, folder)).select("event_id", "user", "place", "object_type")


@query
def label_counts(spark, folder):
    rows = scorer_events(spark, folder)
    labels = rows.where("analyst_label IS NOT NULL").select(
        "event_id", F.col("analyst_label").alias("label"), F.col("us").alias("labelled_at"))
    return A.label_counts(A.with_labels(rows, labels))


@query
def verb_over_time(spark, folder):
    return A.over_time(audits(spark, folder), "verb")


@query
def verb_sliding(spark, folder):
    return A.over_time(audits(spark, folder), "verb", width="1 hour", step="20 minutes")


@query
def verb_resource_share(spark, folder):
    return A.breakdown(audits(spark, folder), "verb", "resource")


@query
def verb_shares(spark, folder):
    return A.shares(audits(spark, folder), "verb")


@query
def resource_shares(spark, folder):
    return A.shares(audits(spark, folder), "resource")


@query
def audits_of_verb(spark, folder):
    """The panel filter: one verb, or all of them."""
    rows = audits(spark, folder)
    one = A.select_equal(rows, "verb", "list").select("event_id", F.lit("list").alias("filter"))
    return one.unionByName(A.select_equal(rows, "verb").select("event_id", F.lit("all").alias("filter")))


@query
def alert_tail(spark, folder):
    """The newest alerts by event time; the number is the panel's."""
    return policy.latest(alerts(spark, folder), 50, by="ts").select("event_id", "rule", "priority")


@query
def recent_store(spark, folder):
    """The newest events by arrival, which is up to 400 hours after the event."""
    return policy.newest(_arrived(spark, folder), 1000).select("event_id")


@query
def samples_in_time(spark, folder):
    """Events that arrived before they were too old to be taken."""
    return policy.reject_old_samples(_arrived(spark, folder)).select("event_id")


def _arrived(spark, folder):
    later = F.make_interval(hours=F.pmod(F.col("event_id") * 7, F.lit(400)).cast("int"))
    return security_rows(spark, folder).select(
        "event_id", F.col("ts").alias("timestamp"), (F.col("ts") + later).alias("ingest_ts"))


@query
def failures_over_time(spark, folder):
    return A.over_time(audits(spark, folder).where("status_code >= 400"), "verb", "resource")


@query
def falco_priority_panels(spark, folder):
    return A.priority_panel(alerts(spark, folder))


@query
def falco_rate(spark, folder):
    return A.over_time(alerts(spark, folder), "priority", width="1 hour")


@query
def top_rules(spark, folder):
    return A.top_k(alerts(spark, folder), 10, "rule")


@query
def top_rules_detail(spark, folder):
    return A.top_k(alerts(spark, folder), 15, "rule", "priority")


@query
def object_types(spark, folder):
    return A.distinct_sorted(scorer_events(spark, folder), "object_type")


@query
def cluster_tree(spark, folder):
    # Regions stand in for nodes, nations for namespaces, suppliers for pods.
    nodes = table(spark, folder, "region").select(
        F.col("r_name").alias("name"),
        F.when(F.col("r_regionkey") == 0, "control-plane").otherwise("worker").alias("role"))
    places = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pods = table(spark, folder, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(F.col("s_suppkey") % 7 == 0, None).when(F.col("s_suppkey") % 11 == 0, F.lit("ghost"))
        .otherwise(F.col("r_name")).alias("node"),
        F.col("n_name").alias("namespace"), F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("app"),
        F.when(F.col("s_acctbal") > 0, "Running").alias("phase"))
    return A.in_tree_order(A.cluster_tree(nodes, pods))


@query
def pods_by_namespace(spark, folder):
    pods = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(F.col("n_nationkey") % 5 == 0, None).otherwise(F.col("n_name")).alias("namespace"),
        F.col("s_name").alias("name"))
    return A.pods_by_namespace(pods)


@query
def services_by_namespace(spark, folder):
    rows = table(spark, folder, "nation").select(
        F.when(F.col("n_regionkey") == 0, None).otherwise(F.col("n_name")).alias("namespace"),
        F.when(F.col("n_nationkey") % 2 == 0, "kubernetes").otherwise(F.col("n_name")).alias("name"),
        F.lit(None).cast("string").alias("type"))
    return A.services_by_namespace(rows)


@query
def order_counters(spark, folder):
    return A.state_counts(table(spark, folder, "orders"), "o_orderstatus",
                          {"pending": "P", "delivered": "F", "cancelled": "O"})


@query
def user_counters(spark, folder):
    return A.state_counts(table(spark, folder, "customer"), "c_mktsegment",
                          {"admins": "MACHINERY", "customers": "HOUSEHOLD", "vendors": "BUILDING"})


@query
def row_validation(spark, folder):
    products = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        (F.col("p_retailprice") - 950).alias("price"), (F.col("p_size") - 3).alias("quantity"))
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("customer"),
        F.lit("p").alias("product"), F.pmod("o_custkey", F.lit(3)).alias("quantity"))
    found = validate.with_violations(products, validate.product_rules()).select(
        F.lit("product").alias("kind"), "id", "violations").unionByName(
        validate.with_violations(orders, validate.order_rules()).select(
            F.lit("order").alias("kind"), "id", "violations"))
    return found.select("kind", "id", F.array_join("violations", ", ").alias("violations"))


@query
def user_validation(spark, folder):
    users = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise("@"),
                 F.lit("shop.example")).alias("email"),
        F.repeat(F.lit("7"), (F.col("c_custkey") % 12 + 6).cast("int")).alias("phone"))
    return validate.invalid_rows(users, validate.user_rules()).select(
        "id", F.array_join("violations", ", ").alias("violations"))


@query
def merge_new_events(spark, folder):
    rows = security_rows(spark, folder).select(F.col("event_id").alias("id"), us("ts").alias("time"), "source_type")
    old = rows.where("source_type <> 'falco'")
    return dedup.merge_new(old, rows)


@query
def insert_unique(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", F.concat(
        F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit("@shop")).alias("email"))
    known = rows.where(F.col("email").startswith("MACHINERY"))
    return dedup.insert_unique(known, rows, "email", "c_custkey")


@query
def partial_update(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    changes = table(spark, folder, "customer").where("c_acctbal < 0").select(
        "c_custkey", F.lit("BLOCKED").alias("c_mktsegment"),
        F.when(F.col("c_nationkey") < 5, F.col("c_nationkey") + 100).alias("c_nationkey"))
    return dedup.partial_update(rows, changes, "c_custkey")


@query
def customer_page(spark, folder):
    return validate.page(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey", 40, 25)


@query
def order_defaults(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"))
    return validate.with_defaults(rows, "orders").select("id", "customer", "quantity", "status")


# --- documented investigations ----------------------------------------------

@query
def uc_daily_summary(spark, folder):
    return U.daily_summary(scorer_events(spark, folder))


@query
def uc_read_bursts(spark, folder):
    return U.read_bursts(scorer_events(spark, folder), words=("secret", "configmap"), minutes=720, factor=2)


@query
def uc_session_bursts(spark, folder):
    return U.session_bursts(scorer_events(spark, folder), gap_us=6 * K.HOUR_US, floor=3)


@query
def uc_change_window(spark, folder):
    return U.outside_change_window(scorer_events(spark, folder)).select("event_id", "user", "object_type", "hour")


@query
def uc_repeat_exec(spark, folder):
    rows = scorer_events(spark, folder).withColumn("target", F.lit("any"))
    return U.repeated_exec(rows, times=2, hours=72)


@query
def uc_first_permission_change(spark, folder):
    return U.first_permission_change(scorer_events(spark, folder), days=4)


@query
def uc_first_secret_access(spark, folder):
    return U.first_secret_access(scorer_events(spark, folder), days=3)


@query
def uc_drift(spark, folder):
    approved = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    observed = approved.where("p_partkey % 13 <> 5").select(
        "p_partkey", F.when(F.col("p_partkey") % 10 == 0, "Brand#X").otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(F.col("p_partkey") % 15 == 0, None).otherwise(F.col("p_size")).alias("p_size"), "p_type")
    return U.workload_drift(approved, observed, "p_partkey", ("p_brand", "p_size", "p_type"))


@query
def uc_403_spikes(spark, folder):
    return U.denial_spikes(scorer_events(spark, folder), minutes=1440, z_limit=1.0)


@query
def uc_unfamiliar_agents(spark, folder):
    return U.unfamiliar_agents(scorer_events(spark, folder))
