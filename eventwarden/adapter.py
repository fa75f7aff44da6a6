"""The test tables seen as security events, in Spark and as the same SQL text.

The test ``events`` table carries no security columns, so they follow from its
ids by fixed arithmetic. ``EVENTS_CTE`` runs unchanged in Spark SQL and in other
engines, which lets a reference query start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventwarden.functions.timestamps import iso_text
from eventwarden.operators.normalize import normalize_events
from eventwarden.operators.pinned import with_pinned
from eventwarden.session import spread

EVENT_COLUMNS_SQL = """
SELECT event_id, ts, user_id, event_type AS app_event, value,
  CASE WHEN event_id % 6 = 0 THEN 'falco' WHEN event_id % 6 = 1 THEN 'app' ELSE 'k8s_audit' END AS source_type,
  CASE WHEN user_id % 5 = 0 THEN 'system:node:n' || CAST(user_id % 3 AS STRING)
       WHEN user_id % 10 = 1 THEN 'system:serviceaccount:prod:sa' || CAST(user_id AS STRING)
       WHEN user_id % 10 = 2 THEN 'deploy-bot-' || CAST(user_id AS STRING)
       ELSE 'user-' || CAST(user_id AS STRING) END AS user_name,
  '10.0.' || CAST(user_id % 7 AS STRING) || '.' || CAST(event_id % 13 AS STRING) AS source_ip,
  CASE event_id % 5 WHEN 0 THEN 'prod' WHEN 1 THEN 'ecommerce' WHEN 2 THEN 'kube-system'
       WHEN 3 THEN 'order-ns' ELSE NULL END AS namespace,
  CASE (event_id * 7 + user_id) % 12
       WHEN 0 THEN 'secrets' WHEN 1 THEN 'configmaps' WHEN 2 THEN 'pods' WHEN 3 THEN 'deployments'
       WHEN 4 THEN 'roles' WHEN 5 THEN 'clusterrolebindings' WHEN 6 THEN 'serviceaccounts'
       WHEN 7 THEN 'namespaces' WHEN 8 THEN 'nodes' WHEN 9 THEN 'leases'
       WHEN 10 THEN 'mutatingwebhookconfigurations' ELSE 'events' END AS resource,
  CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'list' WHEN 'signup' THEN 'create'
       WHEN 'purchase' THEN 'patch' ELSE 'delete' END AS verb,
  CASE WHEN event_id % 23 = 0 THEN 403 WHEN event_id % 29 = 0 THEN 401 WHEN event_id % 31 = 0 THEN 500
       WHEN event_id % 37 = 0 THEN 404 WHEN event_id % 41 = 0 THEN 101 WHEN event_id % 43 = 0 THEN NULL
       WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status_code,
  CASE user_id % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Notice' ELSE 'Error' END AS priority,
  CASE user_id % 5 WHEN 0 THEN 'Terminal shell in container' WHEN 1 THEN 'Write below etc'
       WHEN 2 THEN 'Read sensitive file untrusted' WHEN 3 THEN 'Contact K8S API Server From Container'
       ELSE 'Find AWS Credentials' END AS rule,
  CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS anomaly_score,
  CAST((event_id * 104729) % 1000 AS DOUBLE) / 1000.0 AS previous_score,
  CASE WHEN event_id % 100 = 0 THEN 1 WHEN event_id % 50 = 0 THEN 0 ELSE NULL END AS analyst_label
FROM {events}
"""

SECURITY_COLUMNS_SQL = """
SELECT *,
  CASE WHEN resource = 'pods' AND user_id % 4 = 0 THEN 'exec'
       WHEN resource = 'pods' AND user_id % 4 = 1 THEN 'status'
       WHEN resource = 'nodes' AND user_id % 2 = 0 THEN 'status'
       WHEN resource = 'serviceaccounts' AND user_id % 2 = 0 THEN 'token' ELSE NULL END AS subresource,
  CASE WHEN status_code >= 400 THEN 1 ELSE 0 END AS is_failed
FROM base
"""

# What the raw lines of the three sources carry beyond the security columns.
DETAIL_COLUMNS_SQL = """
SELECT *,
  resource || '-' || CAST(event_id % 17 AS STRING) AS resource_name,
  CASE resource WHEN 'roles' THEN 'rbac.authorization.k8s.io' WHEN 'clusterrolebindings' THEN 'rbac.authorization.k8s.io'
       WHEN 'deployments' THEN 'apps' WHEN 'leases' THEN 'coordination.k8s.io'
       WHEN 'mutatingwebhookconfigurations' THEN 'admissionregistration.k8s.io' ELSE '' END AS api_group,
  CASE WHEN event_id % 53 = 0 THEN '/healthz?x=' || CAST(event_id % 4 AS STRING)
       WHEN event_id % 59 = 0 THEN '/metrics/cadvisor'
       WHEN subresource = 'exec' AND event_id % 2 = 0 THEN '/api/v1/namespaces/' || COALESCE(namespace, 'default')
            || '/pods/p' || CAST(event_id % 17 AS STRING) || '/exec?command=cat&command=%2Fetc%2Fshadow&stdin=true'
       WHEN subresource = 'exec' THEN '/api/v1/namespaces/' || COALESCE(namespace, 'default')
            || '/pods/p' || CAST(event_id % 17 AS STRING) || '/exec?container=c&command=uname+-a'
       ELSE '/apis/' || resource || '/' || CAST(event_id % 17 AS STRING) END AS uri,
  CASE WHEN event_id % 19 = 0 THEN 'admin-' || CAST(user_id % 3 AS STRING) ELSE NULL END AS impersonated,
  'kubectl/1.' || CAST((user_id + CAST((event_id - event_id % 2000) / 2000 AS BIGINT)) % 4 AS STRING) AS user_agent,
  CASE WHEN user_id % 5 = 0 THEN 'system:nodes' ELSE 'system:authenticated' END AS user_group,
  CASE event_id % 8 WHEN 0 THEN 'login denied for root' WHEN 1 THEN 'Traceback in worker'
       WHEN 2 THEN 'order stored' WHEN 3 THEN 'spawned bash -c curl ' WHEN 4 THEN 'reading /var/lib/data'
       WHEN 5 THEN 'Unauthorized token' WHEN 6 THEN 'sudo session opened' ELSE 'cache warmed' END AS app_message,
  CASE user_id % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'get' ELSE NULL END AS app_method,
  CASE WHEN event_id % 4 = 0 THEN 'ERROR' WHEN event_id % 4 = 1 THEN 'notice' WHEN event_id % 4 = 2 THEN 'Warn'
       ELSE NULL END AS app_level,
  CASE WHEN event_id % 5 < 3 THEN NULL ELSE status_code END AS app_status,
  CASE event_id % 9 WHEN 0 THEN 'cat /etc/shadow' WHEN 1 THEN 'apt-get install nmap' WHEN 2 THEN 'bash'
       WHEN 3 THEN 'touch /etc/motd' WHEN 4 THEN 'uname -a' WHEN 5 THEN 'python app.py'
       WHEN 6 THEN 'cp a /usr/local/bin/a' ELSE NULL END AS proc_cmdline,
  CASE event_id % 9 WHEN 2 THEN 'bash' WHEN 5 THEN 'python' WHEN 8 THEN '<NA>' ELSE NULL END AS proc_name,
  CASE event_id % 7 WHEN 0 THEN '/root/.aws/credentials' WHEN 1 THEN '/home/u/.ssh/id_rsa'
       WHEN 2 THEN '10.0.0.9:3000->10.96.0.1:443' WHEN 3 THEN '/usr/local/bin/a' ELSE NULL END AS fd_name
FROM sec
"""

EVENTS_CTE = (
    "base AS (" + EVENT_COLUMNS_SQL.format(events="events").strip() + "),\n"
    "sec AS (" + SECURITY_COLUMNS_SQL.strip() + "),\n"
    "det AS (" + DETAIL_COLUMNS_SQL.strip() + ")"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def security_rows(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """The ``det`` rows of ``EVENTS_CTE``; ``ts`` becomes an instant."""
    events = table(spark, folder, "events") if events is None else events
    text = ("WITH base AS (" + EVENT_COLUMNS_SQL.format(events="{events}") + "), sec AS ("
            + SECURITY_COLUMNS_SQL + ") " + DETAIL_COLUMNS_SQL)
    rows = spark.sql(text, events=events)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def raw_items(spark: SparkSession, folder: str) -> DataFrame:
    """The events as the JSON items their sources would send: ``(event_no, source_type, body)``."""
    # Narrow rows are spread; the columns that follow from them are worked out by all tasks.
    rows = security_rows(spark, folder, spread(table(spark, folder, "events"), "event_id"))
    stamp = iso_text(F.col("ts"))
    audit = F.struct(
        F.concat(F.lit("a-"), F.col("event_id").cast("string")).alias("auditID"),
        stamp.alias("requestReceivedTimestamp"),
        iso_text(F.col("ts") + F.expr("INTERVAL 1500 MILLISECONDS")).alias("stageTimestamp"),
        F.lit("ResponseComplete").alias("stage"), F.lit("Metadata").alias("level"),
        F.col("verb"), F.col("user_agent").alias("userAgent"), F.col("uri").alias("requestURI"),
        F.struct(F.col("user_name").alias("username"), F.array("user_group").alias("groups")).alias("user"),
        F.when(F.col("impersonated").isNotNull(), F.struct(F.col("impersonated").alias("username"))
               ).alias("impersonatedUser"),
        F.struct("namespace", "resource", F.col("resource_name").alias("name"), "subresource",
                 F.col("api_group").alias("apiGroup")).alias("objectRef"),
        F.when(F.col("status_code").isNotNull(), F.struct(F.col("status_code").alias("code"))
               ).alias("responseStatus"),
        F.array("source_ip").alias("sourceIPs"),
    )
    falco = F.struct(
        stamp.alias("time"), F.col("rule"), F.col("priority"),
        F.concat(F.col("rule"), F.lit(" seen by "), F.col("user_name")).alias("output"),
        F.struct(
            F.col("namespace").alias("k8s.ns.name"),
            F.concat(F.lit("pod-"), (F.col("user_id") % 11).cast("string")).alias("k8s.pod.name"),
            F.col("user_name").alias("user.name"), F.col("fd_name").alias("fd.name"),
            F.col("proc_cmdline").alias("proc.cmdline"), F.col("proc_name").alias("proc.name"),
        ).alias("output_fields"),
    )
    app = F.struct(
        stamp.alias("timestamp"), F.lit("order-service").alias("service_name"), F.col("namespace"),
        F.col("app_method").alias("method"), F.col("app_status").alias("status_code"),
        F.col("app_level").alias("log_level"), F.col("app_message").alias("message"),
    )
    body = F.when(F.col("source_type") == "k8s_audit", F.to_json(audit)).when(
        F.col("source_type") == "falco", F.to_json(falco)).otherwise(F.to_json(app))
    return with_pinned(rows, "body", body).select(
        F.col("event_id").alias("event_no"), "source_type", "body", F.col("ts").alias("ingest_ts"))


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_events(raw_items(spark, folder))


def scorer_events(spark: SparkSession, folder: str) -> DataFrame:
    """``security_rows`` as scorer input with flags and epoch microseconds."""
    from eventwarden.plans.features import with_event_flags

    rows = security_rows(spark, folder).select(
        "event_id", "ts", F.col("user_name").alias("user"), "source_ip",
        F.coalesce("namespace", F.lit("cluster-wide")).alias("namespace"),
        F.concat_ws("/", "resource", "subresource").alias("object_type"),
        F.col("verb").alias("method"), F.col("source_type").alias("event_type"),
        "is_failed", "anomaly_score", "previous_score", "analyst_label", "status_code",
        "user_agent", F.col("resource_name").alias("target"),
    )
    return with_event_flags(rows)
