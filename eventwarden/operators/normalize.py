"""Raw event lines to one typed table of security events.

Lines are parsed with a fixed schema per source. A line that is no JSON object,
does not fit its schema, or lacks a required field goes to quarantine; it never
fails its neighbours. There is no shuffle before deduplication.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventwarden import constants as K
from eventwarden import schemas as S
from eventwarden.functions import rules as R
from eventwarden.functions.hashing import fingerprint
from eventwarden.functions.text import blank_to_null, plain_label
from eventwarden.functions.timestamps import event_time, parse_text
from eventwarden.operators.pinned import with_pinned
from eventwarden.operators.policy import noise_reason

EVENT_FIELDS = [
    ("event_id", "string"), ("timestamp", "timestamp"), ("invocation_time", "timestamp"),
    ("completion_time", "timestamp"), ("stage", "string"), ("source_type", "string"),
    ("service_name", "string"), ("namespace", "string"), ("pod_name", "string"),
    ("user_name", "string"), ("user_uid", "string"), ("user_groups", "array<string>"),
    ("effective_user", "string"), ("is_impersonated", "boolean"), ("user_agent", "string"),
    ("severity", "string"), ("event_type", "string"), ("message", "string"),
    ("classification", "string"), ("detection_layer", "string"),
    ("security_relevant", "string"), ("action", "string"), ("resource", "string"),
    ("subresource", "string"), ("resource_name", "string"), ("api_group", "string"),
    ("api_version", "string"), ("status_code", "int"), ("status_reason", "string"),
    ("derived_privileges", "string"), ("request_uri", "string"),
    ("source_ips", "array<string>"), ("fields", "map<string,string>"),
    ("source_namespace", "string"), ("annotations", "map<string,string>"),
    ("tags", "array<string>"), ("raw_event", "string"), ("ingest_ts", "timestamp"),
    ("event_date", "date"),
]


def open_envelope(lines: DataFrame, value: str = "value", default_source: str = "k8s_audit") -> DataFrame:
    """``value`` lines to ``(source_type, body)``; a bare event has no envelope."""
    env = F.from_json(F.col(value), S.ENVELOPE)
    wrapped = env["event"].startswith("{")
    return lines.withColumns({
        "source_type": F.when(wrapped, F.coalesce(env["source_type"], F.lit(default_source)))
                        .otherwise(F.lit(default_source)),
        "body": F.when(wrapped, env["event"]).otherwise(F.col(value)),
    })


def _time_or_arrival() -> Column:
    """The event's own time; an event that names none happened when it arrived."""
    return F.coalesce(F.col("_time"), F.col("ingest_ts"))


def _source_namespace(event: Column) -> Column:
    return F.coalesce(*[blank_to_null(event[k]) for k in K.SOURCE_NAMESPACE_KEYS])


def _no_tags() -> Column:
    return F.array().cast("array<string>")


def _no_fields() -> Column:
    return F.create_map().cast("map<string,string>")


@dataclass(frozen=True)
class Source:
    """How one source becomes events.

    ``time`` names the field of the event time. ``steps`` are columns computed one after the other and used more than once;
    ``fields`` are the event fields. Both get the parsed event, and ``fields`` may
    refer to the steps by name.
    """
    schema: T.StructType
    steps: Callable[[Column], list[dict[str, Column]]]
    fields: Callable[[Column], dict[str, Column]]
    time: str
    required: tuple[str, ...] = ()


# --- audit ------------------------------------------------------------------

def _audit_steps(e: Column) -> list[dict[str, Column]]:
    ref = e["objectRef"]
    verb, message = F.col("audit_verb"), F.col("audit_message")
    return [
        {"audit_verb": F.coalesce(F.nullif(e["verb"], F.lit("")), F.lit("unknown")),
         "audit_time": _time_or_arrival()},
        {"audit_message": R.audit_message(
            e["stage"], verb, ref["resource"], ref["subresource"], ref["name"], e["requestURI"])},
        {"audit_class": R.audit_classification(
            e["responseStatus"]["code"], verb, ref["resource"], ref["subresource"], message,
            e["user"]["username"])},
    ]


def _audit_fields(e: Column) -> dict[str, Column]:
    ref, user, code = e["objectRef"], e["user"], e["responseStatus"]["code"]
    verb, when, message, label = (F.col("audit_" + n) for n in ("verb", "time", "message", "class"))
    other = blank_to_null(e["impersonatedUser"]["username"])
    severity = F.when(label == "unauthorized_access", "unauthorized_access").otherwise(
        R.severity_from_status(code))
    hashed = fingerprint(
        when, source_type=F.lit("k8s_audit"), namespace=ref["namespace"], user_name=user["username"],
        severity=severity, event_type=F.lit("k8s_audit"), message=message, action=verb,
        resource=ref["resource"], resource_name=ref["name"], status_code=code)
    return dict(
        event_id=F.coalesce(F.nullif(e["auditID"], F.lit("")), hashed),
        timestamp=when, invocation_time=when,
        completion_time=F.coalesce(event_time(e["stageTimestamp"]), when),
        stage=F.coalesce(e["stage"], F.lit("")), namespace=ref["namespace"],
        user_name=user["username"], user_uid=user["uid"],
        user_groups=F.coalesce(user["groups"], _no_tags()),
        effective_user=F.coalesce(other, user["username"]), is_impersonated=other.isNotNull(),
        user_agent=e["userAgent"], severity=severity, event_type=F.lit("k8s_audit"),
        message=message, classification=label, security_relevant=R.audit_relevance(label, code),
        action=verb, resource=ref["resource"], subresource=ref["subresource"],
        resource_name=ref["name"], api_group=ref["apiGroup"], api_version=ref["apiVersion"],
        status_code=code, status_reason=e["responseStatus"]["reason"],
        derived_privileges=R.derived_privileges(verb, ref["resource"], ref["subresource"]),
        request_uri=e["requestURI"], source_ips=e["sourceIPs"],
        source_namespace=_source_namespace(e),
        annotations=F.coalesce(e["annotations"], _no_fields()),
    )


# --- runtime alerts ---------------------------------------------------------

def _falco_steps(e: Column) -> list[dict[str, Column]]:
    first, second = F.coalesce(e["output_fields"], _no_fields()), F.coalesce(e["fields"], _no_fields())
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return [{
        "falco_fields": F.map_concat(kept, second),
        "falco_time": _time_or_arrival(),
        "falco_rule": F.coalesce(F.nullif(e["rule"], F.lit("")), F.lit("falco_alert")),
    }]


def _falco_fields(e: Column) -> dict[str, Column]:
    merged, when, rule = (F.col("falco_" + n) for n in ("fields", "time", "rule"))

    def named(key: str) -> Column:
        return F.try_element_at(merged, F.lit(key))

    severity = R.severity_from_priority(e["priority"])
    namespace = F.coalesce(F.nullif(e["k8s"]["k8s.ns.name"], F.lit("")), named("k8s.ns.name"))
    pod = F.coalesce(F.nullif(e["k8s"]["k8s.pod.name"], F.lit("")), named("k8s.pod.name"))
    message = F.coalesce(F.nullif(e["output"], F.lit("")), rule)
    name = F.coalesce(F.nullif(e["container"]["container.name"], F.lit("")),
                      named("container.name"), named("proc.name"))
    return dict(
        event_id=fingerprint(
            when, source_type=F.lit("falco"), namespace=namespace, pod_name=pod, severity=severity,
            event_type=rule, message=message, resource=F.lit("runtime"), resource_name=name),
        timestamp=when, invocation_time=when, completion_time=when, namespace=namespace,
        pod_name=pod, user_groups=_no_tags(), is_impersonated=F.lit(False), severity=severity,
        event_type=rule, message=message, classification=R.falco_classification(rule),
        detection_layer=F.lit("falco"), security_relevant=F.lit("yes"), resource=F.lit("runtime"),
        resource_name=name, fields=merged, annotations=_no_fields(),
    )


# --- application logs -------------------------------------------------------

def _app_steps(e: Column) -> list[dict[str, Column]]:
    return [{
        "app_time": _time_or_arrival(),
        "app_class": R.app_classification(e["status_code"], e["method"], e["message"]),
    }]


def _app_fields(e: Column) -> dict[str, Column]:
    when, label = F.col("app_time"), F.col("app_class")
    code, method = e["status_code"], e["method"]
    plain = F.when(F.coalesce(e["log_level"], F.lit("")) != "", R.severity_from_level(e["log_level"])
                   ).otherwise(R.severity_from_status(code))
    severity = F.when(label == "unauthorized_access", "unauthorized_access").otherwise(plain)
    is_http = (F.coalesce(e["request_path"], F.lit("")) != "") | (F.coalesce(method, F.lit("")) != "")
    kind = F.when(is_http, "http_request").otherwise("app_log")
    hashed = fingerprint(
        when, source_type=F.lit("app"), service_name=e["service_name"], namespace=e["namespace"],
        pod_name=e["pod_name"], severity=severity, event_type=kind, message=e["message"],
        action=method, resource=F.lit("http"), resource_name=e["request_path"], status_code=code)
    return dict(
        event_id=F.coalesce(F.nullif(e["event_id"], F.lit("")), hashed), timestamp=when,
        service_name=e["service_name"], namespace=e["namespace"], pod_name=e["pod_name"],
        severity=severity, event_type=kind, message=e["message"], classification=label,
        security_relevant=R.app_relevance(label), action=method, resource=F.lit("http"),
        resource_name=e["request_path"], status_code=code, source_namespace=_source_namespace(e),
    )


SOURCES = {
    "k8s_audit": Source(S.AUDIT, _audit_steps, _audit_fields, "requestReceivedTimestamp"),
    "falco": Source(S.FALCO, _falco_steps, _falco_fields, "time"),
    "app": Source(S.APP, _app_steps, _app_fields, "timestamp", required=("message",)),
}


def _is(source: str) -> Column:
    return F.col("source_type") == source


def _parsed(items: DataFrame) -> DataFrame:
    """Add the parsed event of each source, null for rows of the others, and ``problem``.

    All sources are parsed in one pass over the items.
    """
    options = {"columnNameOfCorruptRecord": S.CORRUPT}
    parsed = F.struct(*[
        F.when(_is(name), F.from_json("body", source.schema, options)).alias(name)
        for name, source in SOURCES.items()])
    rows = with_pinned(items, "_event", parsed)
    named = F.coalesce(*[F.when(_is(name), blank_to_null(F.col("_event")[name][source.time]))
                         for name, source in SOURCES.items()])
    rows = with_pinned(rows.withColumn("_named_time", named), "_time", event_time(F.col("_named_time")))
    problem = F.when(~F.coalesce(F.col("source_type").isin(*SOURCES), F.lit(False)), "unknown source")
    for name, source in SOURCES.items():
        event = F.col("_event")[name]
        problem = problem.when(_is(name) & (event.isNull() | event[S.CORRUPT].isNotNull()), "unreadable")
        for required in source.required:
            problem = problem.when(_is(name) & event[required].isNull(), f"{required} missing")
    problem = problem.when(F.col("_named_time").isNotNull() & F.col("_time").isNull(), "unreadable time")
    return rows.withColumn("problem", problem)


def normalize_events(items: DataFrame) -> DataFrame:
    """``(source_type, body)`` items of all sources to security events.

    Works on batch and streaming frames. An ``ingest_ts`` column is kept.
    """
    rows = _parsed(items).where(F.col("problem").isNull())
    if "ingest_ts" not in items.columns:
        rows = rows.withColumn("ingest_ts", F.current_timestamp())
    fields = {}
    for name, source in SOURCES.items():
        event = F.col("_event")[name]
        for step in source.steps(event):
            rows = rows.withColumns({c: F.when(_is(name), value) for c, value in step.items()})
        fields[name] = source.fields(event)
    shared = {"source_type": F.col("source_type"), "raw_event": F.col("body"),
              "tags": _no_tags(), "ingest_ts": F.col("ingest_ts")}

    def field(name: str, kind: str) -> Column:
        if name in shared:
            return shared[name].cast(kind).alias(name)
        case = F
        for source, known in fields.items():
            if name in known:
                case = case.when(_is(source), known[name].cast(kind))
        return case.alias(name)

    out = rows.select(*[field(n, k) for n, k in EVENT_FIELDS if n != "event_date"])
    return out.withColumn("event_date", F.to_date("timestamp"))


def quarantine(items: DataFrame) -> DataFrame:
    """Items ``normalize_events`` leaves out: ``(source_type, body, problem)``."""
    return _parsed(items).where(F.col("problem").isNotNull()).select("source_type", "body", "problem")


# --- text sources -----------------------------------------------------------

def parse_access_lines(lines: DataFrame, message: str = "message", container: str = "container_name",
                       container_id: str = "container_id") -> DataFrame:
    """Container log lines to application log items.

    The level follows from the status class of an access-log line, else from
    the words of the message.
    """
    method, path, code = (F.regexp_extract(message, K.ACCESS_LOG_PATTERN, i) for i in (1, 2, 3))
    body = F.to_json(F.struct(
        F.coalesce(container, F.lit("unknown-service")).alias("service_name"),
        F.lit("docker-compose").alias("namespace"),
        F.col(container_id).alias("pod_name"),
        F.col(message).alias("message"),
        F.nullif(method, F.lit("")).alias("method"),
        F.nullif(path, F.lit("")).alias("request_path"),
        code.try_cast("int").alias("status_code"),
        R.text_level(code, F.col(message)).alias("log_level"),
        F.struct(F.col(message).alias("raw")).alias("extra"),
    ))
    return lines.withColumns({"source_type": F.lit("app"), "body": body})


def from_app_containers(lines: DataFrame, container: str = "container_name") -> DataFrame:
    names = "|".join(K.APP_CONTAINERS)
    return lines.where(F.coalesce(F.col(container), F.lit("")).rlike(names))


def outside_system_namespaces(lines: DataFrame, path: str = "path") -> DataFrame:
    names = "|".join(K.IGNORED_NAMESPACES)
    return lines.where(~F.col(path).rlike(f"/({names})/"))


def from_runtime_pods(lines: DataFrame, pod: str = "pod_name") -> DataFrame:
    """Pods of the runtime sensor itself, without its forwarding sidekick."""
    name = F.coalesce(F.col(pod), F.lit(""))
    return lines.where(name.startswith("falco-") & ~name.startswith("falco-falcosidekick"))


def forward_audit(lines: DataFrame, value: str = "value") -> DataFrame:
    """Audit log lines as the node agent passes them on: ``(source_type, body)`` items.

    Known fields are projected with their defaults, the whole event is kept beside
    them, and noise is left out before anything is sent.
    """
    rows = with_pinned(lines, "_a", F.from_json(value, S.AUDIT))
    a, ref = F.col("_a"), F.col("_a")["objectRef"]
    verb = F.coalesce(a["verb"], F.lit("unknown"))
    uri = F.coalesce(a["requestURI"], F.lit("/unknown"))
    noise = noise_reason(verb, ref["resource"], ref["subresource"], uri, a["user"]["username"])
    whole = F.struct(F.col(value).alias("raw_line"))
    same = ("auditID", "requestReceivedTimestamp", "stageTimestamp", "stage", "userAgent", "user",
            "impersonatedUser", "objectRef", "responseStatus", "sourceIPs")
    body = F.to_json(F.struct(
        *[a[name].alias(name) for name in same], verb.alias("verb"), uri.alias("requestURI"),
        F.coalesce(a["annotations"], _no_fields()).alias("annotations"), whole.alias("extra")))
    return rows.where(noise.isNull()).select(F.lit("k8s_audit").alias("source_type"), body.alias("body"))


def parse_sensor_lines(lines: DataFrame, value: str = "message") -> DataFrame:
    """Output lines of the runtime sensor as items, with stream labels."""
    e = F.from_json(value, S.FALCO)
    rule, priority = e["rule"], e["priority"]
    return lines.select(
        "*", F.lit("falco").alias("source_type"), F.col(value).alias("body"),
        F.create_map(F.lit("source"), F.lit("falco"), F.lit("source_type"), F.lit("falco"),
                     F.lit("rule"), plain_label(rule),
                     F.lit("priority"), F.coalesce(priority, F.lit(""))).alias("labels"))
