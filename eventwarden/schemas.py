"""Input schemas of the three event sources, and the scorer input."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_TEXT_LIST = T.ArrayType(T.StringType())
_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

# ``event`` stays text: a nested object read as STRING keeps its JSON.
ENVELOPE = T.StructType(_strings("source_type", "source", "event"))

AUDIT = T.StructType([
    *_strings("auditID", "requestReceivedTimestamp", "stageTimestamp", "stage", "level",
              "verb", "userAgent", "requestURI"),
    T.StructField("user", T.StructType([
        *_strings("username", "uid"),
        T.StructField("groups", _TEXT_LIST),
        T.StructField("extra", T.StringType()),
    ])),
    T.StructField("impersonatedUser", T.StructType([
        *_strings("username", "uid"),
        T.StructField("groups", _TEXT_LIST),
    ])),
    T.StructField("objectRef", T.StructType(
        _strings("namespace", "resource", "name", "subresource", "apiVersion", "apiGroup"))),
    T.StructField("responseStatus", T.StructType([
        T.StructField("code", T.IntegerType()),
        *_strings("status", "reason", "message"),
    ])),
    T.StructField("sourceIPs", _TEXT_LIST),
    T.StructField("annotations", _TEXT_MAP),
    *_strings("requestObject", "sourceNamespace", "src_namespace", "srcNamespace"),
    T.StructField(CORRUPT, T.StringType()),
])

FALCO = T.StructType([
    *_strings("time", "rule", "priority", "output", "hostname", "source"),
    T.StructField("k8s", T.StructType(_strings("k8s.ns.name", "k8s.pod.name"))),
    T.StructField("container", T.StructType(_strings("container.name", "container.image"))),
    T.StructField("proc", T.StructType(_strings("proc.name"))),
    T.StructField("fields", _TEXT_MAP),
    T.StructField("output_fields", _TEXT_MAP),
    T.StructField(CORRUPT, T.StringType()),
])

APP = T.StructType([
    *_strings("event_id", "timestamp", "service_name", "namespace", "pod_name",
              "request_path", "method"),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("response_time", T.DoubleType()),
    *_strings("log_level", "message", "extra"),
    *_strings("sourceNamespace", "src_namespace", "srcNamespace"),
    T.StructField(CORRUPT, T.StringType()),
])

# History files carry a header; columns are read by name, all as text.
HISTORY_COLUMNS = {
    "Timestamp (UTC)": "timestamp_utc",
    "Invocation Time": "invocation_time",
    "Event Type": "event_type",
    "Classification": "classification",
    "Result": "result",
    "User / Subject": "user",
    "Method": "method",
    "Source IP": "source_ip",
    "Namespace": "namespace",
    "Object Type": "object_type",
    "Object Name": "object_name",
    "_label": "label",
}

# Columns every frame given to the feature jobs must have.
SCORER_INPUT = (
    "event_id", "ts", "user", "source_ip", "namespace", "object_type", "method",
    "event_type", "is_failed",
)
