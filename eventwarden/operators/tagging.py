"""Tags of a security event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.functions.text import contains_any, lower_or_empty
from eventwarden.operators.pinned import with_pinned


def build_tags(message: Column, event_type: Column, classification: Column, source_type: Column,
               status_code: Column, action: Column, resource: Column, namespace: Column,
               source_namespace: Column, given: Column) -> Column:
    """Ordered distinct tags; a tag seen first keeps its place."""
    text = F.lower(F.concat(F.coalesce(message, F.lit("")), F.lit(" "), F.coalesce(event_type, F.lit(""))))
    label = F.trim(classification)
    denied = F.coalesce(status_code.isin(*K.AUTH_DENIED_CODES), F.lit(False))
    foreign = (F.coalesce(source_namespace, F.lit("")) != "") & (F.coalesce(namespace, F.lit("")) != "") \
        & (source_namespace != namespace)
    changes = lower_or_empty(action).isin(*K.WRITE_VERBS) & \
        lower_or_empty(resource).isin(*K.TAG_CONFIG_RESOURCES)
    found = F.array(
        F.when(label != "", F.concat(F.lit("classification:"), label)),
        F.when(source_type == "falco", "runtime-falco"),
        F.when(contains_any(text, K.TAG_PRIVILEGE), "privilege-escalation"),
        F.when(contains_any(text, K.TAG_AUTH_FAILURE) | denied, "auth-failure"),
        F.when(contains_any(text, K.TAG_FILE_ACCESS), "file-access"),
        F.when(contains_any(text, K.TAG_RUNTIME), "suspicious-runtime"),
        F.when(changes, "config-change"),
        F.when(foreign, "cross-namespace"),
    )
    everything = F.concat(found, F.coalesce(given, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(everything, lambda t: t.isNotNull() & (t != "")))


def tag_events(events: DataFrame) -> DataFrame:
    """Events with their tags; the rules are pinned, so a filter on the tags does not repeat them."""
    tags = build_tags(*[F.col(c) for c in (
        "message", "event_type", "classification", "source_type", "status_code", "action",
        "resource", "namespace", "source_namespace", "tags")])
    rows = with_pinned(events, "_tags", tags)
    return rows.select(*[F.col("_tags").alias(c) if c == "tags" else F.col(c) for c in events.columns])
