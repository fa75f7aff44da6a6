"""What to keep: audit levels, noise, namespaces, fields, age."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.functions.rules import is_kubelet_routine, is_probe_path
from eventwarden.functions.text import any_of, lower_or_empty

ALL_STAGES = ("RequestReceived", "ResponseStarted", "ResponseComplete")
ENDS = ("RequestReceived", "ResponseComplete")
READS = ("get", "list", "watch")
RBAC_GROUP = "rbac.authorization.k8s.io"


@dataclass(frozen=True)
class AuditRule:
    """Level and stages for requests that match; empty parts match anything."""
    level: str
    verbs: Sequence[str] = ()
    targets: Sequence[tuple[str, Sequence[str]]] = ()   # (api group, resources)
    user_groups: Sequence[str] = ()
    stages: Sequence[str] = ALL_STAGES


# The first matching rule decides.
AUDIT_RULES = (
    AuditRule("RequestResponse", K.WRITE_VERBS, ((RBAC_GROUP, K.RBAC_RESOURCES),)),
    AuditRule("RequestResponse", K.WRITE_VERBS + READS, (("", ("secrets",)),)),
    AuditRule("RequestResponse", K.WRITE_VERBS, (("", ("serviceaccounts",)),)),
    AuditRule("RequestResponse", ("create",), (("", ("serviceaccounts/token",)),)),
    AuditRule("Request", ("create", "get"),
              (("", ("pods/exec", "pods/attach", "pods/portforward")),)),
    AuditRule("Request", K.WRITE_VERBS, (("", ("configmaps",)),)),
    AuditRule("Request", ("create", "delete"), (("", ("namespaces",)),)),
    AuditRule("Request", K.WRITE_VERBS,
              (("apps", ("deployments", "statefulsets", "daemonsets", "replicasets")),)),
    AuditRule("Request", K.WRITE_VERBS, (("networking.k8s.io", ("networkpolicies",)),)),
    AuditRule("Request", K.WRITE_VERBS,
              (("admissionregistration.k8s.io", K.WEBHOOK_RESOURCES),)),
    AuditRule("Metadata", ("create", "delete"), (("", ("pods",)),), stages=ENDS),
    AuditRule("Metadata", K.WRITE_VERBS,
              (("", ("persistentvolumes", "persistentvolumeclaims")),), stages=ENDS),
    AuditRule("None", READS, (
        ("", ("events", "endpoints", "nodes/status", "pods/status", "pods/log")),
        ("apps", ("replicasets",)),
        ("autoscaling", ("horizontalpodautoscalers",)))),
    AuditRule("None", READS, (("", ("nodes", "nodes/status", "configmaps")),), ("system:nodes",)),
    AuditRule("Metadata", K.WRITE_VERBS),
    AuditRule("None"),
)


def _matches(rule: AuditRule, verb: Column, group: Column, target: Column, groups: Column) -> Column:
    parts = [F.lit(True)]
    if rule.verbs:
        parts.append(verb.isin(*rule.verbs))
    if rule.targets:
        parts.append(any_of((group == g) & target.isin(*names) for g, names in rule.targets))
    if rule.user_groups:
        parts.append(F.arrays_overlap(groups, F.array(*[F.lit(g) for g in rule.user_groups])))
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def audit_policy(verb: Column, api_group: Column, resource: Column, subresource: Column,
                 user_groups: Column, rules: Sequence[AuditRule] = AUDIT_RULES) -> Column:
    """Struct ``(level, stages)`` of the first rule that matches."""
    sub = F.coalesce(subresource, F.lit(""))
    target = F.concat(F.coalesce(resource, F.lit("")),
                      F.when(sub != "", F.concat(F.lit("/"), sub)).otherwise(""))
    group = F.coalesce(api_group, F.lit(""))
    groups = F.coalesce(user_groups, F.array().cast("array<string>"))
    case = F
    for rule in rules:
        decision = F.struct(F.lit(rule.level).alias("level"),
                            F.array(*[F.lit(s) for s in rule.stages]).alias("stages"))
        case = case.when(_matches(rule, lower_or_empty(verb), group, target, groups), decision)
    return case


def apply_audit_policy(events: DataFrame, rules: Sequence[AuditRule] = AUDIT_RULES) -> DataFrame:
    """Audit events the policy records, with their level."""
    decision = audit_policy(F.col("action"), F.col("api_group"), F.col("resource"),
                            F.col("subresource"), F.col("user_groups"), rules)
    return (
        events.withColumn("_policy", decision)
        .where((F.col("_policy.level") != "None")
               & ((F.coalesce("stage", F.lit("")) == "") | F.array_contains("_policy.stages", F.col("stage"))))
        .withColumn("audit_level", F.col("_policy.level")).drop("_policy")
    )


def noise_reason(verb: Column, resource: Column, subresource: Column, uri: Column,
                 user: Column) -> Column:
    """Why an audit event is dropped before ingest; null when it is kept."""
    v, r = lower_or_empty(verb), lower_or_empty(resource)
    churn = (F.coalesce(resource, F.lit("")) == "events") & v.isin("patch", "update")
    return (
        F.when(churn, "event object churn")
        .when(is_probe_path(uri), "health probe")
        .when((r == "leases") & v.isin(*K.LEASE_VERBS), "lease heartbeat")
        .when(r.isin(*K.REVIEW_RESOURCES) & (v == "create"), "access review")
        .when(is_kubelet_routine(user, verb, resource, subresource), "kubelet routine")
        .when(F.coalesce(verb, F.lit("unknown")) == "unknown", "unknown verb")
    )


def drop_noise(events: DataFrame) -> DataFrame:
    reason = noise_reason(F.col("action"), F.col("resource"), F.col("subresource"),
                          F.col("request_uri"), F.col("user_name"))
    return events.where((F.col("source_type") != "k8s_audit") | reason.isNull())


def is_kept(source_type: Column, namespace: Column, status_code: Column, classification: Column,
            allowed: Sequence[str] | None = None,
            ignored: Sequence[str] = K.IGNORED_NAMESPACES) -> Column:
    """Namespace policy: the blocklist first, then the allowlist if there is one.

    Runtime alerts and denied audit requests are always kept.
    """
    blocked = F.coalesce(namespace.isin(*ignored), F.lit(False)) if ignored else F.lit(False)
    listed = F.lit(True) if allowed is None else F.coalesce(namespace.isin(*allowed), F.lit(False))
    denied = (F.coalesce(status_code.isin(*K.AUTH_DENIED_CODES), F.lit(False))
              | (F.coalesce(classification, F.lit("")) == "unauthorized_access"))
    return ((source_type == "falco") | ((source_type == "k8s_audit") & denied)
            | (~blocked & listed))


def apply_namespace_policy(events: DataFrame, allowed: Sequence[str] | None = None,
                           ignored: Sequence[str] = K.IGNORED_NAMESPACES) -> DataFrame:
    return events.where(is_kept(F.col("source_type"), F.col("namespace"), F.col("status_code"),
                                F.col("classification"), allowed, ignored))


def shape_fields(events: DataFrame, keep: Sequence[str] | None = None, store_raw: bool = True,
                 max_bytes: int | None = None) -> DataFrame:
    """Keep the chosen fields; with ``max_bytes``, larger raw events become a marker with their size."""
    size = F.octet_length("raw_event")
    trimmed = F.to_json(F.struct(F.lit(True).alias("_trimmed"), size.alias("_bytes")))
    raw = F.col("raw_event") if max_bytes is None else F.when(size > max_bytes, trimmed).otherwise(F.col("raw_event"))
    raw = raw if store_raw else F.lit("{}")
    out = events.withColumn("raw_event", raw)
    if keep:
        wanted = set(keep) | set(K.FORCED_FIELDS)
        out = out.select(*[c for c in out.columns if c in wanted])
    return out


def reject_old_samples(events: DataFrame, hours: int = K.MAX_SAMPLE_AGE_HOURS) -> DataFrame:
    limit = F.expr(f"ingest_ts - INTERVAL {int(hours)} HOURS")
    return events.where(F.col("timestamp") >= limit)


def within_retention(events: DataFrame, days: float, now: Column | None = None) -> DataFrame:
    """Rows younger than ``days`` whole days, at least one; no limit when not positive.

    The date test prunes partitions, the time test is exact.
    """
    if days <= 0:
        return events
    age = max(1, int(days))
    edge = (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {age} DAYS")
    return events.where((F.col("event_date") >= F.to_date(edge)) & (F.col("timestamp") >= edge))


def newest(events: DataFrame, limit: int = K.RECENT_STORE_ROWS, ttl_seconds: int = 0,
           by: str = "ingest_ts") -> DataFrame:
    """The recent store: newest rows by arrival, optionally not older than a TTL."""
    if ttl_seconds > 0:
        events = events.where(F.col(by) >= F.current_timestamp() - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))
    return events.orderBy(F.col(by).desc(), F.col("event_id").desc()).limit(limit)


def latest(events: DataFrame, limit: int = 100, by: str = "timestamp") -> DataFrame:
    """Newest rows by event time; none when the limit is not positive."""
    return events.orderBy(F.col(by).desc(), F.col("event_id").desc()).limit(max(limit, 0))
