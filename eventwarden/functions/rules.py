"""Severity, classification and relevance of events, as ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.functions.text import (
    contains_any, first_match, lower_or_empty, slug, starts_with_any,
)


def _denied(code: Column) -> Column:
    return F.coalesce(code.isin(*K.AUTH_DENIED_CODES), F.lit(False))


# --- severity ---------------------------------------------------------------

def severity_from_level(level: Column) -> Column:
    word = lower_or_empty(F.trim(level))
    return first_match([
        (word.isin(*K.LEVEL_WARNING), "warning"),
        (word.isin(*K.LEVEL_CRITICAL), "critical"),
    ], "info")


def severity_from_status(code: Column) -> Column:
    return first_match([
        (code.isNull(), "info"),
        (_denied(code), "unauthorized_access"),
        (code.between(200, 399), "info"),
        (code.between(400, 499), "warning"),
    ], "critical")


def severity_from_priority(priority: Column) -> Column:
    word = lower_or_empty(F.trim(priority))
    return first_match([
        (word.isin(*K.PRIORITY_INFO), "info"),
        (word.isin(*K.PRIORITY_CRITICAL), "critical"),
    ], "warning")


def counter_severity(severity: Column) -> Column:
    """Severity bucket a processed event is counted under."""
    word = F.lower(F.coalesce(severity, F.lit("info")))
    return (F.when(word.isin(*K.SEVERITIES), word)
            .when(word.isin("error", "fatal"), "critical")
            .otherwise("info"))


def status_result(code: Column) -> Column:
    return F.when(F.coalesce(code, F.lit(200)) < 400, "Success").otherwise("Failure")


# --- audit ------------------------------------------------------------------

def is_kubelet_routine(user: Column, verb: Column, resource: Column, subresource: Column) -> Column:
    """Node agents deleting pods or rotating their own tokens."""
    u, v, r, s = (lower_or_empty(c) for c in (user, verb, resource, subresource))
    deletes_pod = (v == "delete") & (r == "pods")
    rotates_token = (v == "create") & (r == "serviceaccounts") & (s == "token")
    return u.startswith(K.NODE_USER_PREFIX) & (deletes_pod | rotates_token)


def is_exec(subresource: Column, *texts: Column) -> Column:
    found = lower_or_empty(subresource).isin(*K.EXEC_SUBRESOURCES)
    for text in texts:
        found = found | contains_any(lower_or_empty(text), K.EXEC_PATHS)
    return found


def audit_classification(code: Column, verb: Column, resource: Column, subresource: Column,
                         message: Column, user: Column) -> Column:
    u, v, r, s, m = (lower_or_empty(c) for c in (user, verb, resource, subresource, message))
    writes = v.isin(*K.WRITE_VERBS)
    node_status = (u.startswith(K.NODE_USER_PREFIX) & (v == "patch")
                   & r.isin("pods", "nodes") & (s == "status"))
    return first_match([
        (is_kubelet_routine(user, verb, resource, subresource), "kubelet_routine"),
        (node_status, "kubelet_status_reconciliation"),
        (_denied(code) | contains_any(m, K.DENIAL_WORDS), "unauthorized_access"),
        (is_exec(subresource, message) | (v == "exec"), "exec_access"),
        (r.isin(*K.RBAC_RESOURCES) & writes, "rbac_change"),
        (r.isin(*K.SECRET_RESOURCES), "secret_access"),
        (r.isin(*K.PRIVILEGE_RESOURCES) & v.isin("create", "delete"),
         "privilege_escalation_candidate"),
        (r.isin(*K.WORKLOAD_RESOURCES) & (v == "delete"), "destructive_change"),
        (r.isin(*K.CONFIG_RESOURCES) & writes, "config_change"),
        (r.isin(*K.WEBHOOK_RESOURCES), "admission_webhook_change"),
    ], "normal_operation")


def audit_relevance(classification: Column, code: Column) -> Column:
    routine = classification.isin(*K.KUBELET_CLASSES) & ~_denied(code)
    return F.when(routine, "no").otherwise("yes")


def audit_message(stage: Column, verb: Column, resource: Column, subresource: Column,
                  name: Column, uri: Column) -> Column:
    """``[stage] verb resource/sub name uri=...``; a missing part leaves its blank."""
    blank = F.lit("")
    target = F.concat(
        F.coalesce(resource, blank),
        F.when(F.coalesce(subresource, blank) != "", F.concat(F.lit("/"), subresource)).otherwise(""),
    )
    head = F.trim(F.concat(F.lit("["), F.coalesce(stage, blank), F.lit("] "), verb, F.lit(" "),
                           target, F.lit(" "), F.coalesce(name, blank)))
    return F.when(F.coalesce(uri, blank) != "", F.concat(head, F.lit(" uri="), uri)).otherwise(head)


def derived_privileges(verb: Column, resource: Column, subresource: Column) -> Column:
    v, r, s = (lower_or_empty(c) for c in (verb, resource, subresource))
    target = F.when(s != "", F.concat(r, F.lit("/"), s)).otherwise(r)
    parts = F.concat_ws(",", F.nullif(v, F.lit("")), F.nullif(target, F.lit("")))
    return F.nullif(parts, F.lit(""))


# --- application logs and runtime alerts ------------------------------------

def app_classification(code: Column, method: Column, message: Column) -> Column:
    acts = (F.coalesce(method, F.lit("")) != "") & ~F.upper(method).isin(*K.APP_READ_METHODS)
    return first_match([
        (_denied(code), "unauthorized_access"),
        (code.between(500, 599), "application_server_error"),
        (code.between(400, 499), "application_client_error"),
        (code.between(200, 399), "application_http_ok"),
        (contains_any(lower_or_empty(message), K.APP_ERROR_WORDS), "application_error_signal"),
        (acts, "application_mutation_or_action"),
    ], "application_log")


def app_relevance(classification: Column) -> Column:
    return F.when(classification.isin(*K.APP_RELEVANT_CLASSES), "yes").otherwise("no")


def falco_classification(rule: Column) -> Column:
    named = F.coalesce(F.nullif(F.trim(rule), F.lit("")), F.lit("falco_alert"))
    return F.concat(F.lit("falco_"), slug(named, "alert"))


def text_level(code_text: Column, message: Column) -> Column:
    """Log level of a raw line: from the status class, else from its words."""
    text = lower_or_empty(message)
    return first_match([
        (code_text.startswith("5"), "critical"),
        (code_text.startswith("4"), "warning"),
        (contains_any(text, K.LEVEL_WORDS_CRITICAL), "critical"),
        (contains_any(text, K.LEVEL_WORDS_ERROR), "error"),
        (contains_any(text, K.LEVEL_WORDS_WARNING), "warning"),
    ], "info")


# --- scores -----------------------------------------------------------------

def risk_level(score: Column, scale: tuple[float, float] = K.LIVE_RISK) -> Column:
    high, medium = scale
    return first_match([(score > high, "HIGH"), (score > medium, "MEDIUM")], "LOW")


def is_human_workload_change(user: Column, object_type: Column, method: Column,
                             strict: bool = False) -> Column:
    """A person, not automation, writes to a workload.

    Markers match anywhere in the name, so ``ci`` also matches inside ordinary
    names; ``strict`` matches them as whole words instead.
    """
    who = lower_or_empty(user)
    if strict:
        words = "|".join(m.rstrip(":") for m in K.AUTOMATION_MARKERS)
        automated = who.rlike(rf"(^|[^a-z])({words})([^a-z]|$)")
    else:
        automated = contains_any(who, K.AUTOMATION_MARKERS)
    return (~automated & contains_any(lower_or_empty(object_type), K.HUMAN_WORKLOADS)
            & lower_or_empty(method).isin(*K.WRITE_VERBS))


def is_critical_alert(risk: Column, score: Column, event_type: Column, method: Column,
                      object_type: Column, reason: Column,
                      min_score: float = K.ALERT_MIN_SCORE) -> Column:
    action, target, why = (lower_or_empty(c) for c in (method, object_type, reason))
    runtime = contains_any(action, K.ALERT_RUNTIME_WORDS) | contains_any(why, K.ALERT_RUNTIME_WORDS)
    control = action.isin(*K.ALERT_METHODS) & contains_any(target, K.ALERT_RESOURCES)
    critical = F.when(lower_or_empty(event_type) == "falco", runtime).otherwise(control)
    return (F.coalesce(risk, F.lit("")) == "HIGH") & (F.coalesce(score, F.lit(0.0)) >= min_score) & critical


def is_probe_path(uri: Column) -> Column:
    return starts_with_any(lower_or_empty(uri), K.PROBE_PATHS)
