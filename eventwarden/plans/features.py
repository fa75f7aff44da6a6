"""Feature jobs: event flags, rolling history, the ordered feature matrix, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.functions.hashing import hash_bucket
from eventwarden.functions.text import contains_any, safe
from eventwarden.functions.timestamps import epoch_us, is_off_hours
from eventwarden.operators.ordered import DEFAULT_POLICY, SlicePolicy, Spread, span_of
from eventwarden.operators.rolling import IP_PLAN, USER_PLAN, with_rolling


def with_event_flags(events: DataFrame) -> DataFrame:
    """Clean the scorer input and add the flags that need no history."""
    method, target = F.lower(safe(F.col("method"))), F.lower(safe(F.col("object_type")))
    hour = F.hour("ts")
    out = events.withColumns({
        "user": safe(F.col("user")),
        "source_ip": safe(F.col("source_ip")),
        "namespace": safe(F.col("namespace")),
        "event_type": safe(F.col("event_type")),
        "method": method,
        "object_type": target,
        "us": epoch_us(F.col("ts")),
        "hour": hour,
        "day_of_week": F.weekday("ts"),
        "is_off_hours": is_off_hours(hour).cast("int"),
        "is_sensitive": contains_any(target, K.SENSITIVE_WORDS).cast("int"),
        "is_high_risk": method.isin(*K.HIGH_RISK_METHODS).cast("int"),
        "is_rbac": contains_any(target, K.RBAC_WORDS).cast("int"),
    })
    return out


def _share(part: str, whole: str, digits: int | None = 4) -> Column:
    ratio = F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return ratio if digits is None else F.bround(ratio, digits)


HISTORY_INPUT = ("event_id", "user", "source_ip", "namespace", "object_type", "us",
                 "is_failed", "is_sensitive")


def with_user_history(rows: DataFrame, events: DataFrame | None = None,
                      policy: SlicePolicy = DEFAULT_POLICY, digits: int | None = 4,
                      span: Spread | None = None) -> DataFrame:
    """Rows with the rolling behaviour of their user."""
    events = (rows if events is None else events).select(*HISTORY_INPUT)
    return user_rates(with_rolling(rows, USER_PLAN, events, policy=policy, span=span), digits)


def user_rates(found: DataFrame, digits: int | None = 4) -> DataFrame:
    """The measures of ``USER_PLAN`` with their shares."""
    return found.withColumns({
        "fail_ratio_7d": _share("failed_7d", "req_7d", digits),
        "sensitive_rate_7d": _share("sensitive_7d", "req_7d", digits),
        "is_new_user": (F.col("req_30d") == 0).cast("int"),
    }).drop("failed_7d", "sensitive_7d")


def with_ip_history(rows: DataFrame, events: DataFrame | None = None,
                    policy: SlicePolicy = DEFAULT_POLICY, digits: int | None = 4,
                    span: Spread | None = None) -> DataFrame:
    """Rows with the rolling behaviour of their source address."""
    events = (rows if events is None else events).select(*HISTORY_INPUT)
    return ip_rates(with_rolling(rows, IP_PLAN, events, policy=policy, span=span), digits)


def ip_rates(found: DataFrame, digits: int | None = 4) -> DataFrame:
    """The measures of ``IP_PLAN`` with their shares."""
    return found.withColumns({
        "ip_fail_ratio_24h": _share("ip_failed_24h", "ip_req_24h", digits),
        "is_new_ip": (F.col("ip_req_24h") == 0).cast("int"),
    }).drop("ip_failed_24h")


def rolling_features(events: DataFrame, policy: SlicePolicy = DEFAULT_POLICY,
                     digits: int | None = 4) -> DataFrame:
    """Every event with the history of its user and of its address: one shuffle each."""
    span = span_of(events, "us")
    by_user = with_user_history(events, events, policy, digits, span)
    return with_ip_history(by_user, events, policy, digits, span)


def feature_matrix(events: DataFrame, policy: SlicePolicy = DEFAULT_POLICY, bucket=hash_bucket) -> DataFrame:
    """Events with the 29 feature columns, in their fixed order, at the end."""
    return feature_columns(rolling_features(events, policy), bucket)


def feature_columns(rows: DataFrame, bucket=hash_bucket) -> DataFrame:
    """Rows with the history of their user and address, and the 29 feature columns at the end."""
    hashed = {
        "feat_user_hash": "user", "feat_ip_hash": "source_ip",
        "feat_namespace_hash": "namespace", "feat_object_type_hash": "object_type",
        "feat_method_hash": "method", "feat_event_type_hash": "event_type",
    }
    plain = {
        "feat_hour": "hour", "feat_day_of_week": "day_of_week",
        "feat_is_off_hours": "is_off_hours", "feat_is_sensitive": "is_sensitive",
        "feat_is_failed": "is_failed", "feat_is_high_risk_method": "is_high_risk",
        "feat_hist_req_24h": "req_24h", "feat_hist_req_7d": "req_7d",
        "feat_hist_req_30d": "req_30d", "feat_hist_fail_ratio_7d": "fail_ratio_7d",
        "feat_hist_unique_namespaces": "unique_namespaces",
        "feat_hist_unique_resources": "unique_resources",
        "feat_hist_unique_ips": "unique_ips",
        "feat_hist_sensitive_rate_7d": "sensitive_rate_7d",
        "feat_hist_user_hour_baseline": "user_hour_baseline",
        "feat_is_new_user": "is_new_user", "feat_hist_ip_req_24h": "ip_req_24h",
        "feat_hist_ip_fail_ratio_24h": "ip_fail_ratio_24h",
        "feat_hist_ip_unique_users": "ip_unique_users", "feat_is_new_ip": "is_new_ip",
        "feat_fail_burst_5min": "fail_burst_5min", "feat_is_rbac_resource": "is_rbac",
    }
    features = {name: bucket(F.col(c), K.HASH_BUCKETS[c]) for name, c in hashed.items()}
    features.update({name: F.col(c) for name, c in plain.items()})
    features["feat_sensitive_offhour"] = F.col("is_sensitive") * F.col("is_off_hours")
    absent = [c for c in K.FEATURE_COLS if c not in features]
    if absent:
        raise ValueError(f"features without a definition: {absent}")
    return rows.select(
        *rows.columns,
        *[features[c].cast("double").alias(c) for c in K.FEATURE_COLS],
    )


def reason_text() -> Column:
    """Why an event looks suspicious, over the columns of ``rolling_features``."""
    daily = F.col("req_30d") / 30
    failing = F.col("fail_ratio_7d")

    def whole(value: Column) -> Column:
        return F.bround(value, 0).cast("bigint").cast("string")

    parts = [
        F.when((F.col("is_sensitive") == 1) & (F.col("is_off_hours") == 1), F.concat(
            F.lit("sensitive resource '"), F.col("object_type"),
            F.lit("' accessed outside business hours"))),
        F.when(F.col("is_new_user") == 1,
               F.lit("actor has NO activity history in the last 30 days")),
        F.when(F.col("is_new_ip") == 1, F.lit("source IP has never been seen before")),
        F.when((F.col("req_30d") > 0) & (F.col("req_24h") > daily * 5), F.concat(
            F.lit("request burst: "), F.col("req_24h").cast("string"),
            F.lit(" requests in 24h vs daily avg of "), whole(daily))),
        F.when(failing > 0.3, F.concat(
            F.lit("high failure rate: "), whole(failing * 100), F.lit("% of requests failing"))),
        F.when((F.col("is_high_risk") == 1) & (F.col("is_sensitive") == 1), F.concat(
            F.lit("high-risk method '"), F.col("method"), F.lit("' on sensitive resource"))),
        F.when(F.col("ip_unique_users") > 10, F.concat(
            F.lit("source IP used by "), F.col("ip_unique_users").cast("string"),
            F.lit(" different actors"))),
    ]
    return F.coalesce(
        F.nullif(F.concat_ws("; ", *parts), F.lit("")),
        F.lit("statistical outlier in learned behavior model"))
