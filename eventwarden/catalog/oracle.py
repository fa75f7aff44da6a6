"""The registered queries as plain SQL over the same tables, for a second engine."""

from __future__ import annotations

from eventwarden import constants as K
from eventwarden.adapter import EVENTS_CTE
from eventwarden.catalog.queries import SMALL_RANGE
from eventwarden.models.forest import expected_path

DAY = 86_400_000_000

# Scorer-shaped events.
SCO = """sco AS (
  SELECT event_id, ts, epoch_us(ts) AS us, user_name AS "user", source_ip,
    coalesce(namespace, 'cluster-wide') AS namespace,
    concat_ws('/', resource, subresource) AS object_type, verb AS method, source_type AS event_type,
    is_failed, anomaly_score, previous_score, analyst_label, status_code, user_agent,
    resource_name AS target, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week
  FROM det
), flg AS (
  SELECT *,
    CASE WHEN hour < 6 OR hour > 20 THEN 1 ELSE 0 END AS is_off_hours,
    CASE WHEN regexp_matches(object_type, 'secret|configmap|clusterrole|rolebinding|exec') THEN 1 ELSE 0 END AS is_sensitive,
    CASE WHEN method IN ('create', 'delete', 'patch', 'update') THEN 1 ELSE 0 END AS is_high_risk,
    CASE WHEN regexp_matches(object_type, 'role|serviceaccount') THEN 1 ELSE 0 END AS is_rbac
  FROM sco
)"""

# The three sources as normalized events.
NORM = """aud AS (
  SELECT *, '[ResponseComplete] ' || verb || ' ' || resource || coalesce('/' || subresource, '') || ' '
      || resource_name || ' uri=' || uri AS message
  FROM det WHERE source_type = 'k8s_audit'
), acl AS (
  SELECT *, CASE
    WHEN user_name LIKE 'system:node:%' AND ((verb = 'delete' AND resource = 'pods')
      OR (verb = 'create' AND resource = 'serviceaccounts' AND subresource = 'token')) THEN 'kubelet_routine'
    WHEN user_name LIKE 'system:node:%' AND verb = 'patch' AND resource IN ('pods', 'nodes') AND subresource = 'status'
      THEN 'kubelet_status_reconciliation'
    WHEN status_code IN (401, 403) THEN 'unauthorized_access'
    WHEN subresource = 'exec' OR contains(message, '/exec') THEN 'exec_access'
    WHEN resource IN ('roles', 'clusterrolebindings') AND verb IN ('create', 'patch', 'delete') THEN 'rbac_change'
    WHEN resource = 'secrets' THEN 'secret_access'
    WHEN resource IN ('serviceaccounts', 'clusterrolebindings') AND verb IN ('create', 'delete') THEN 'privilege_escalation_candidate'
    WHEN verb = 'delete' AND resource IN ('deployments', 'pods', 'namespaces') THEN 'destructive_change'
    WHEN resource = 'configmaps' AND verb IN ('create', 'patch', 'delete') THEN 'config_change'
    WHEN resource = 'mutatingwebhookconfigurations' THEN 'admission_webhook_change'
    ELSE 'normal_operation' END AS cls
  FROM aud
), iso AS (
  SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE
      '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS stamp FROM det
), fal AS (
  SELECT *, 'pod-' || CAST(user_id % 11 AS VARCHAR) AS pod_name, rule || ' seen by ' || user_name AS message,
    CASE priority WHEN 'Notice' THEN 'info' WHEN 'Warning' THEN 'warning' ELSE 'critical' END AS sev
  FROM iso WHERE source_type = 'falco'
), apl AS (
  SELECT *, CASE
    WHEN app_status IN (401, 403) THEN 'unauthorized_access'
    WHEN app_status BETWEEN 500 AND 599 THEN 'application_server_error'
    WHEN app_status BETWEEN 400 AND 499 THEN 'application_client_error'
    WHEN app_status BETWEEN 200 AND 399 THEN 'application_http_ok'
    WHEN regexp_matches(lower(app_message), 'traceback|exception|error|fatal|panic') THEN 'application_error_signal'
    WHEN upper(app_method) NOT IN ('GET', 'HEAD', 'OPTIONS') THEN 'application_mutation_or_action'
    ELSE 'application_log' END AS cls
  FROM iso WHERE source_type = 'app'
), aps AS (
  SELECT *, CASE
    WHEN cls = 'unauthorized_access' THEN 'unauthorized_access'
    WHEN app_level = 'ERROR' THEN 'critical' WHEN app_level = 'Warn' THEN 'warning' WHEN app_level = 'notice' THEN 'info'
    WHEN app_status IS NULL THEN 'info' WHEN app_status BETWEEN 200 AND 399 THEN 'info'
    WHEN app_status BETWEEN 400 AND 499 THEN 'warning' ELSE 'critical' END AS sev,
    CASE WHEN app_method IS NULL THEN 'app_log' ELSE 'http_request' END AS kind
  FROM apl
), norm AS (
  SELECT event_id AS event_no, 'a-' || CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) AS us, epoch_us(ts) + 1500000 AS completed_us,
    source_type, CAST(NULL AS VARCHAR) AS service_name, namespace, CAST(NULL AS VARCHAR) AS pod_name, user_name,
    coalesce(impersonated, user_name) AS effective_user, impersonated IS NOT NULL AS is_impersonated,
    CASE WHEN cls = 'unauthorized_access' OR status_code IN (401, 403) THEN 'unauthorized_access' WHEN status_code IS NULL THEN 'info'
      WHEN status_code BETWEEN 200 AND 399 THEN 'info' WHEN status_code BETWEEN 400 AND 499 THEN 'warning' ELSE 'critical' END AS severity,
    'k8s_audit' AS event_type, message, cls AS classification,
    CASE WHEN cls LIKE 'kubelet%' AND coalesce(status_code, 200) NOT IN (401, 403) THEN 'no' ELSE 'yes' END AS security_relevant,
    verb AS action, resource, subresource, resource_name, api_group, status_code,
    verb || ',' || resource || coalesce('/' || subresource, '') AS derived_privileges, uri, user_group, impersonated, user_agent, source_ip
  FROM acl
  UNION ALL
  SELECT event_id, sha256(CAST(to_json(struct_pack(action := NULL, event_type := rule, message := message, namespace := namespace,
      pod_name := pod_name, resource := 'runtime', resource_name := proc_name, service_name := NULL, severity := sev,
      source_type := 'falco', status_code := NULL, tags := CAST([] AS VARCHAR[]), "timestamp" := stamp, user_name := NULL)) AS VARCHAR)),
    epoch_us(ts), epoch_us(ts), source_type, NULL, namespace, pod_name, NULL, NULL, false, sev, rule, message,
    'falco_' || lower(replace(rule, ' ', '_')), 'yes', NULL, 'runtime', NULL, proc_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, source_ip
  FROM fal
  UNION ALL
  SELECT event_id, sha256(CAST(to_json(struct_pack(action := app_method, event_type := kind, message := app_message, namespace := namespace,
      pod_name := NULL, resource := 'http', resource_name := NULL, service_name := 'order-service', severity := sev,
      source_type := 'app', status_code := app_status, tags := CAST([] AS VARCHAR[]), "timestamp" := stamp, user_name := NULL)) AS VARCHAR)),
    epoch_us(ts), NULL, source_type, 'order-service', namespace, NULL, NULL, NULL, NULL, sev, kind, app_message, cls,
    CASE WHEN cls IN ('application_http_ok', 'application_log') THEN 'no' ELSE 'yes' END,
    app_method, 'http', NULL, NULL, NULL, app_status, NULL, NULL, NULL, NULL, NULL, source_ip
  FROM aps
)"""

# Runtime rows: alerts, and exec requests shown like alerts.
RUN = """run AS (
  SELECT n.event_id, n.event_no, n.us, n.namespace, n.severity, n.classification, n.event_type, n.message, n.status_code, n.user_name, n.security_relevant,
    CASE WHEN n.source_type = 'falco' THEN 'falco' ELSE 'exec' END AS kind,
    CASE WHEN n.source_type = 'falco' THEN d.proc_cmdline
         WHEN contains(n.uri, 'command=cat') THEN 'cat /etc/shadow' WHEN contains(n.uri, 'command=uname') THEN 'uname -a' END AS command,
    CASE WHEN n.source_type = 'falco' THEN d.fd_name END AS path,
    CASE WHEN n.source_type = 'falco' THEN nullif(d.proc_name, '<NA>') END AS process,
    n.effective_user AS invoker, n.resource_name, n.pod_name, n.uri
  FROM norm n JOIN det d ON d.event_id = n.event_no
  WHERE n.source_type = 'falco' OR (n.source_type = 'k8s_audit' AND (n.classification = 'exec_access' OR n.subresource = 'exec'))
), lab AS (
  SELECT *, lower(coalesce(command, '')) AS c, coalesce(path, '') AS p,
    CASE WHEN kind = 'falco' THEN coalesce(process, '') ELSE coalesce(split_part(command, ' ', 1), '') END AS q,
    lower(coalesce(command, '')) || ' ' || coalesce(path, '') || ' '
      || lower(CASE WHEN kind = 'falco' THEN message ELSE coalesce(command, '') END) AS hay
  FROM run
), act AS (
  SELECT *, CASE
    WHEN kind = 'exec' AND command IS NULL THEN 'Container exec'
    WHEN regexp_matches(hay, '/etc/(shadow|sudoers|passwd)') THEN 'Read sensitive file'
    WHEN contains(hay, '.aws/credentials') THEN 'Searched cloud credentials'
    WHEN contains(hay, '.ssh') THEN 'Read SSH information'
    WHEN contains(hay, 'touch /etc') THEN 'Wrote under etc'
    WHEN p LIKE '/usr/local/bin%' AND regexp_matches(c, 'touch|write|open|cp|mv') THEN 'Wrote binary directory'
    WHEN contains(c, 'apt-get install') THEN 'Ran package manager'
    WHEN q = 'bash' THEN 'Spawned interactive shell'
    WHEN contains(c, 'uname') THEN 'Collected system information'
    WHEN contains(p, ':443') AND contains(p, '10.96.') THEN 'Contacted Kubernetes API'
    WHEN kind = 'exec' THEN 'Runtime security alert'
    ELSE CASE event_type WHEN 'Terminal shell in container' THEN 'Spawned interactive shell' WHEN 'Write below etc' THEN 'Wrote under etc'
      WHEN 'Read sensitive file untrusted' THEN 'Read sensitive file'
      WHEN 'Contact K8S API Server From Container' THEN 'Contacted Kubernetes API' ELSE 'Searched cloud credentials' END
    END AS runtime_action
  FROM lab
), rtr AS (
  SELECT *,
    CASE WHEN kind = 'exec' THEN coalesce(command, uri)
         ELSE coalesce(nullif(concat_ws(' | ', command, CASE WHEN NOT contains(coalesce(command, ''), path) THEN path END,
              CASE WHEN NOT contains(coalesce(command, ''), process) THEN 'process=' || process END), ''), message) END AS runtime_detail,
    CASE WHEN kind = 'falco' THEN coalesce(namespace || '/' || pod_name, pod_name) || ' · ' || (SELECT user_name FROM det WHERE det.event_id = act.event_no)
         ELSE coalesce(namespace || '/' || resource_name, resource_name) END AS workload,
    CASE runtime_action WHEN 'Read sensitive file' THEN 'Critical' WHEN 'Searched cloud credentials' THEN 'Critical'
      WHEN 'Read SSH information' THEN 'Warning' WHEN 'Wrote under etc' THEN 'Warning' WHEN 'Wrote binary directory' THEN 'Warning'
      WHEN 'Ran package manager' THEN 'Warning' WHEN 'Spawned interactive shell' THEN 'Notice'
      WHEN 'Collected system information' THEN 'Notice' WHEN 'Container exec' THEN 'Notice' WHEN 'Runtime security alert' THEN 'Notice'
      ELSE CASE severity WHEN 'critical' THEN 'Critical' WHEN 'unauthorized_access' THEN 'Critical' WHEN 'warning' THEN 'Warning' ELSE 'Notice' END
      END AS priority
  FROM act
)"""

# Rolling history by frames over microseconds.
_D1, _D7, _D30 = (f"RANGE BETWEEN {n * DAY} PRECEDING AND 1 PRECEDING" for n in (1, 7, 30))
_M5 = "RANGE BETWEEN 300000000 PRECEDING AND 1 PRECEDING"
ROLL = f"""rol AS (
  SELECT *,
    COUNT(*) OVER (PARTITION BY "user" ORDER BY us {_D1}) AS req_24h,
    COUNT(*) OVER (PARTITION BY "user" ORDER BY us {_D7}) AS req_7d,
    COUNT(*) OVER (PARTITION BY "user" ORDER BY us {_D30}) AS req_30d,
    coalesce(SUM(is_failed) OVER (PARTITION BY "user" ORDER BY us {_D7}), 0) AS failed_7d,
    coalesce(SUM(is_sensitive) OVER (PARTITION BY "user" ORDER BY us {_D7}), 0) AS sensitive_7d,
    COUNT(*) OVER (PARTITION BY "user", hour ORDER BY us {_D30}) AS user_hour_baseline,
    COUNT(*) OVER (PARTITION BY source_ip ORDER BY us {_D1}) AS ip_req_24h,
    coalesce(SUM(is_failed) OVER (PARTITION BY source_ip ORDER BY us {_D1}), 0) AS ip_failed_24h,
    CAST(coalesce(SUM(is_failed) OVER (PARTITION BY source_ip ORDER BY us {_M5}), 0) AS BIGINT) AS fail_burst_5min
  FROM flg
), rat AS (
  SELECT *,
    CASE WHEN req_7d > 0 THEN CAST(failed_7d AS DOUBLE) / req_7d ELSE 0.0 END AS fail_ratio_7d,
    CASE WHEN req_7d > 0 THEN CAST(sensitive_7d AS DOUBLE) / req_7d ELSE 0.0 END AS sensitive_rate_7d,
    CASE WHEN ip_req_24h > 0 THEN CAST(ip_failed_24h AS DOUBLE) / ip_req_24h ELSE 0.0 END AS ip_fail_ratio_24h,
    CASE WHEN req_30d = 0 THEN 1 ELSE 0 END AS is_new_user,
    CASE WHEN ip_req_24h = 0 THEN 1 ELSE 0 END AS is_new_ip
  FROM rol
)"""


def _distinct(key: str, column: str, width: int) -> str:
    return (f'(SELECT COUNT(DISTINCT h.{column}) FROM flg h WHERE h.{key} = e.{key} '
            f'AND h.us >= e.us - {width} AND h.us < e.us)')


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join((EVENTS_CTE,) + ctes) + "\n"


_SCO, _NORM, _RUN = _with(SCO), _with(NORM), _with(NORM, RUN)
_ROLL, _DET = _with(SCO, ROLL), _with()
_EVENTS_SCO = _SCO


def _hash(column: str, buckets: int) -> str:
    # The 32 hexadecimal digits of the digest, eight at a time.
    text = f"md5({column})"
    acc = "0"
    for i in range(4):
        acc = f"(({acc}) * 4294967296 + CAST('0x' || substr({text}, {8 * i + 1}, 8) AS BIGINT)) % {buckets}"
    return f"CAST({acc} AS INT)"


_HASHED = (
    ("user", '"user"', 10000), ("source_ip", "source_ip", 10000), ("namespace", "namespace", 5000),
    ("object_type", "object_type", 2000), ("method", "method", 100), ("event_type", "event_type", 500),
)
_FEATURES = (
    ("feat_user_hash", "user_hash"), ("feat_ip_hash", "source_ip_hash"), ("feat_namespace_hash", "namespace_hash"),
    ("feat_object_type_hash", "object_type_hash"), ("feat_method_hash", "method_hash"), ("feat_event_type_hash", "event_type_hash"),
    ("feat_hour", "hour"), ("feat_day_of_week", "day_of_week"), ("feat_is_off_hours", "is_off_hours"),
    ("feat_is_sensitive", "is_sensitive"), ("feat_is_failed", "is_failed"), ("feat_is_high_risk_method", "is_high_risk"),
    ("feat_sensitive_offhour", "is_sensitive * is_off_hours"), ("feat_hist_req_24h", "req_24h"), ("feat_hist_req_7d", "req_7d"),
    ("feat_hist_req_30d", "req_30d"), ("feat_hist_fail_ratio_7d", "round_even(fail_ratio_7d, 4)"),
    ("feat_hist_unique_namespaces", "unique_namespaces"), ("feat_hist_unique_resources", "unique_resources"),
    ("feat_hist_unique_ips", "unique_ips"), ("feat_hist_sensitive_rate_7d", "round_even(sensitive_rate_7d, 4)"),
    ("feat_hist_user_hour_baseline", "user_hour_baseline"), ("feat_is_new_user", "is_new_user"),
    ("feat_hist_ip_req_24h", "ip_req_24h"), ("feat_hist_ip_fail_ratio_24h", "round_even(ip_fail_ratio_24h, 4)"),
    ("feat_hist_ip_unique_users", "ip_unique_users"), ("feat_is_new_ip", "is_new_ip"),
    ("feat_fail_burst_5min", "fail_burst_5min"), ("feat_is_rbac_resource", "is_rbac"),
)


def _bins(column: str) -> str:
    edges = [i * 0.1 for i in range(10)] + [1.0]
    parts = []
    for i in range(10):
        upper = "<" if i < 9 else "<="
        parts.append(f"WHEN {column} >= CAST({edges[i]!r} AS DOUBLE) AND {column} {upper} CAST({edges[i + 1]!r} AS DOUBLE) THEN {i}")
    return "CASE " + " ".join(parts) + " END"


_PSI = f"""tot AS (SELECT count(previous_score) AS n_old, count(anomaly_score) AS n_new FROM flg),
bins AS (SELECT unnest(range(10)) AS b),
shr AS (
  SELECT b,
    CASE WHEN o = 0 THEN 0.0001 ELSE CAST(o AS DOUBLE) / n_old END AS e,
    CASE WHEN a = 0 THEN 0.0001 ELSE CAST(a AS DOUBLE) / n_new END AS a
  FROM (SELECT b, (SELECT count(*) FROM flg WHERE {_bins('previous_score')} = b) AS o,
               (SELECT count(*) FROM flg WHERE {_bins('anomaly_score')} = b) AS a FROM bins), tot
), psi AS (SELECT n_old, n_new, psi FROM tot, (SELECT sum((a - e) * ln(a / e)) AS psi FROM shr))"""

_RISK = "CASE WHEN anomaly_score > 0.9 THEN 'HIGH' WHEN anomaly_score > 0.6 THEN 'MEDIUM' ELSE 'LOW' END"

_DIGEST = """SELECT count(*) AS total_events, count(DISTINCT "user") AS unique_actors,
  count(*) FILTER (anomaly_score > 0.9) AS high_risk,
  count(*) FILTER (anomaly_score > 0.6 AND anomaly_score <= 0.9) AS medium_risk,
  count(*) FILTER (anomaly_score <= 0.6) AS low_risk FROM """

_SLUG = "regexp_replace(regexp_replace(trim(text), '[^a-zA-Z0-9]+', '{0}', 'g'), '^{0}+|{0}+$', '', 'g')"


_REASON = """coalesce(nullif(concat_ws('; ',
              CASE WHEN is_sensitive = 1 AND is_off_hours = 1 THEN 'sensitive resource ''' || object_type || ''' accessed outside business hours' END,
              CASE WHEN is_new_user = 1 THEN 'actor has NO activity history in the last 30 days' END,
              CASE WHEN is_new_ip = 1 THEN 'source IP has never been seen before' END,
              CASE WHEN req_30d > 0 AND req_24h > CAST(req_30d AS DOUBLE) / 30 * 5 THEN 'request burst: ' || CAST(req_24h AS VARCHAR)
                || ' requests in 24h vs daily avg of ' || CAST(CAST(round_even(CAST(req_30d AS DOUBLE) / 30, 0) AS BIGINT) AS VARCHAR) END,
              CASE WHEN fail_ratio_7d > 0.3 THEN 'high failure rate: ' || CAST(CAST(round_even(fail_ratio_7d * 100, 0) AS BIGINT) AS VARCHAR) || '% of requests failing' END,
              CASE WHEN is_high_risk = 1 AND is_sensitive = 1 THEN 'high-risk method ''' || method || ''' on sensitive resource' END,
              CASE WHEN ip_unique_users > 10 THEN 'source IP used by ' || CAST(ip_unique_users AS VARCHAR) || ' different actors' END), ''),
              'statistical outlier in learned behavior model')"""

# The small forest of ``catalog.queries`` as nested choices.
_ROUNDED = _REASON.replace("fail_ratio_7d", "round_even(fail_ratio_7d, 4)")
_LOW, _HIGH = SMALL_RANGE
_WALKED = _ROLL + f""", ips AS (SELECT *, {_distinct('source_ip', '"user"', DAY)} AS ip_unique_users FROM rat e),
  walk AS (SELECT *, (CASE WHEN hour > 11.5 THEN CASE WHEN is_sensitive > 0.5 THEN 6.0::DOUBLE ELSE 4.0::DOUBLE END
      WHEN is_failed > 0.5 THEN 3.5::DOUBLE ELSE 2.0::DOUBLE END
    + CASE WHEN req_7d > 20.5 THEN CASE WHEN round_even(fail_ratio_7d, 4) > 0.05 THEN 4.25::DOUBLE ELSE 6.5::DOUBLE END
      WHEN day_of_week > 2.5 THEN 3.0::DOUBLE ELSE 5.5::DOUBLE END) / 2 AS path FROM ips),
  raws AS (SELECT *, -pow(2.0::DOUBLE, -path / {expected_path(K.FOREST_SAMPLE)!r}::DOUBLE) AS raw FROM walk),
  tot AS (SELECT *, 1.0::DOUBLE - (raw - ({_LOW!r})::DOUBLE) / {_HIGH - _LOW!r}::DOUBLE AS total FROM raws)
"""

# Items that are stored, dropped by the namespace policy, or noise.
_JUDGED = """SELECT *, source_type = 'falco'
    OR (source_type = 'k8s_audit' AND (coalesce(status_code, 0) IN (401, 403) OR classification = 'unauthorized_access'))
    OR coalesce(namespace, '') <> 'kube-system' AS kept FROM norm WHERE NOT (source_type = 'k8s_audit' AND ((resource = 'events' AND action = 'patch')
      OR uri LIKE '/healthz%' OR uri LIKE '/metrics%' OR (resource = 'leases' AND action IN ('get', 'patch')) OR classification = 'kubelet_routine'))"""


def all_oracles() -> dict[str, str]:
    return {
        # ingest
        "normalized_events": _NORM + """SELECT event_id, us, completed_us, source_type, service_name, namespace, pod_name, user_name,
            effective_user, is_impersonated, severity, event_type, message, classification, security_relevant, action, resource,
            subresource, resource_name, api_group, status_code, derived_privileges FROM norm""",
        "epoch_times": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000
              WHEN 1 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) END AS us
            FROM events WHERE event_id % 4 <> 3 AND event_id % 7 <> 0""",
        "quarantined_items": """SELECT 'app' AS source_type, '{"event_id":"' || event_id || '","message":"m","timestamp":' || CASE event_id % 4
              WHEN 0 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) WHEN 1 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR)
              WHEN 2 THEN '"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE
                '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00"'
              ELSE '"soon"' END || CASE WHEN event_id % 7 = 0 THEN '' ELSE '}' END AS body,
              CASE WHEN event_id % 7 = 0 THEN 'unreadable' ELSE 'unreadable time' END AS problem
            FROM events WHERE event_id % 7 = 0 OR event_id % 4 = 3""",
        "classification_breakdown": _NORM + "SELECT source_type, classification, count(*) AS events FROM norm GROUP BY ALL",
        "ingest_counters": _NORM + """SELECT 'source_type' AS dimension, source_type AS value, count(*) AS events FROM norm GROUP BY source_type
            UNION ALL SELECT 'severity', severity, count(*) FROM norm GROUP BY severity UNION ALL SELECT 'total', 'all', count(*) FROM norm""",
        "ingest_summary": _NORM + """SELECT count(*) AS accepted, count(*) FILTER (kept) AS stored, count(*) FILTER (NOT kept) AS dropped,
            CAST(0 AS BIGINT) AS failed FROM (SELECT source_type = 'falco'
            OR (source_type = 'k8s_audit' AND (coalesce(status_code, 0) IN (401, 403) OR classification = 'unauthorized_access'))
            OR coalesce(namespace, '') <> 'kube-system' AS kept FROM norm WHERE NOT (source_type = 'k8s_audit' AND ((resource = 'events' AND action = 'patch') OR uri LIKE '/healthz%' OR uri LIKE '/metrics%'
              OR (resource = 'leases' AND action IN ('get', 'patch')) OR classification = 'kubelet_routine')))""",
        "ingest_summary_parity": _NORM + """SELECT count(*) AS accepted, count(*) FILTER (kept) AS stored, count(*) FILTER (NOT kept) AS dropped,
            count(*) FILTER (NOT kept) AS failed FROM (SELECT source_type = 'falco'
            OR (source_type = 'k8s_audit' AND (coalesce(status_code, 0) IN (401, 403) OR classification = 'unauthorized_access'))
            OR coalesce(namespace, '') <> 'kube-system' AS kept FROM norm WHERE NOT (source_type = 'k8s_audit' AND ((resource = 'events' AND action = 'patch') OR uri LIKE '/healthz%' OR uri LIKE '/metrics%'
              OR (resource = 'leases' AND action IN ('get', 'patch')) OR classification = 'kubelet_routine')))""",
        "batch_report": _NORM + f""", facts AS (SELECT event_id, source_type, severity, CASE WHEN kept THEN 'stored' ELSE 'dropped' END AS outcome FROM ({_JUDGED})
            UNION ALL SELECT NULL, 'app', NULL, 'failed' FROM events WHERE event_id % 7 = 0 OR event_id % 4 = 3),
            parts AS (SELECT 'source_type' AS dimension, coalesce(source_type, 'unknown') AS value, outcome FROM facts
              UNION ALL SELECT 'severity', coalesce(severity, 'unknown'), outcome FROM facts UNION ALL SELECT 'total', 'all', outcome FROM facts)
            SELECT dimension, value, count(*) AS accepted, count(*) FILTER (outcome = 'stored') AS stored, count(*) FILTER (outcome = 'dropped') AS dropped,
              count(*) FILTER (outcome = 'failed') AS failed, CASE WHEN dimension = 'total' THEN (SELECT string_agg(event_id, ',' ORDER BY event_id)
                FROM (SELECT event_id FROM facts WHERE outcome = 'stored' ORDER BY event_id LIMIT 10)) END AS ids FROM parts GROUP BY dimension, value""",
        "stored_events": _NORM + """SELECT event_id, source_type, namespace, classification FROM norm WHERE (source_type = 'falco'
            OR (source_type = 'k8s_audit' AND (coalesce(status_code, 0) IN (401, 403) OR classification = 'unauthorized_access'))
            OR coalesce(namespace, '') <> 'kube-system')
            AND NOT (source_type = 'k8s_audit' AND ((resource = 'events' AND action = 'patch') OR uri LIKE '/healthz%' OR uri LIKE '/metrics%'
              OR (resource = 'leases' AND action IN ('get', 'patch')) OR classification = 'kubelet_routine'))""",
        "audit_policy_level": _NORM + """SELECT event_id, level, NOT (level = 'Metadata' AND resource = 'pods' AND subresource IS NULL) AS records_started FROM (
            SELECT *, CASE
              WHEN resource IN ('roles', 'clusterrolebindings') AND subresource IS NULL AND action IN ('create', 'patch', 'delete') THEN 'RequestResponse'
              WHEN resource = 'secrets' THEN 'RequestResponse'
              WHEN resource = 'serviceaccounts' AND subresource IS NULL AND action IN ('create', 'patch', 'delete') THEN 'RequestResponse'
              WHEN resource = 'serviceaccounts' AND subresource = 'token' AND action = 'create' THEN 'RequestResponse'
              WHEN resource = 'pods' AND subresource = 'exec' AND action IN ('create', 'get') THEN 'Request'
              WHEN resource = 'configmaps' AND action IN ('create', 'patch', 'delete') THEN 'Request'
              WHEN resource = 'namespaces' AND action IN ('create', 'delete') THEN 'Request'
              WHEN resource = 'deployments' AND action IN ('create', 'patch', 'delete') THEN 'Request'
              WHEN resource = 'mutatingwebhookconfigurations' AND action IN ('create', 'patch', 'delete') THEN 'Request'
              WHEN action IN ('create', 'patch', 'delete') THEN 'Metadata' ELSE 'None' END AS level
            FROM norm WHERE source_type = 'k8s_audit' AND action <> '') WHERE true
            AND NOT (level = 'Metadata' AND resource = 'pods' AND subresource IS NULL AND action = 'patch')
            UNION ALL SELECT event_id, 'Metadata', true FROM norm WHERE source_type = 'k8s_audit' AND resource = 'pods'
            AND subresource IS NULL AND action = 'patch'""",
        "noise_filters": _NORM + """SELECT event_id, CASE WHEN resource = 'events' AND action = 'patch' THEN 'event object churn'
            WHEN uri LIKE '/healthz%' OR uri LIKE '/metrics%' THEN 'health probe'
            WHEN resource = 'leases' AND action IN ('get', 'patch') THEN 'lease heartbeat'
            WHEN classification = 'kubelet_routine' THEN 'kubelet routine' END AS reason FROM norm WHERE source_type = 'k8s_audit'""",
        "namespace_policy": _NORM + """SELECT event_id, always OR coalesce(namespace, '') <> 'kube-system' AS kept_by_default,
            always OR coalesce(namespace, '') = 'prod' AS kept_by_allowlist FROM (SELECT *, source_type = 'falco'
            OR (source_type = 'k8s_audit' AND (coalesce(status_code, 0) IN (401, 403) OR classification = 'unauthorized_access')) AS always FROM norm)""",
        "tags_exploded": _NORM + """, txt AS (SELECT *, message || ' ' || event_type AS t FROM norm),
            arr AS (SELECT event_id, list_filter([
              'classification:' || classification, CASE WHEN source_type = 'falco' THEN 'runtime-falco' END,
              CASE WHEN regexp_matches(t, '(?i)privilege|sudo|setuid|cap_sys_admin|root') THEN 'privilege-escalation' END,
              CASE WHEN regexp_matches(t, '(?i)unauthorized|forbidden|authentication failed|denied') OR status_code IN (401, 403) THEN 'auth-failure' END,
              CASE WHEN regexp_matches(t, '(?i)open\\(|chmod|chown|/etc/|/var/|/root/') THEN 'file-access' END,
              CASE WHEN regexp_matches(t, '(?i)exec|spawn|shell|bash|sh -c|nc |curl |wget ') THEN 'suspicious-runtime' END,
              CASE WHEN action IN ('create', 'patch', 'delete') AND resource IN ('configmaps', 'secrets', 'roles', 'clusterrolebindings') THEN 'config-change' END
            ], lambda x: x IS NOT NULL) AS tags FROM txt)
            SELECT event_id, CAST(i - 1 AS INT) AS pos, tags[i] AS tag FROM (SELECT event_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM arr)""",
        "field_retention": """SELECT doc_id AS event_id, source AS message, CASE WHEN b > 4000 THEN b END AS trimmed_bytes,
            CASE WHEN b <= 4000 THEN CAST(length(text) AS INT) END AS chars_kept FROM (SELECT *, strlen(text) AS b FROM documents)""",
        "forwarded_audit": _NORM + """SELECT event_id, classification, uri AS request_uri, user_name FROM norm WHERE source_type = 'k8s_audit'
            AND NOT ((resource = 'events' AND action = 'patch') OR uri LIKE '/healthz%' OR uri LIKE '/metrics%'
              OR (resource = 'leases' AND action IN ('get', 'patch')) OR classification = 'kubelet_routine')""",
        "sensor_lines": _DET + "SELECT event_id, lower(replace(rule, ' ', '_')) AS rule, priority FROM det WHERE source_type = 'falco' AND event_id % 4 <> 0",
        "container_lines": """SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '-order-service-1' ELSE '-user-service' END AS container_name
            FROM documents WHERE doc_id % 3 < 2 AND doc_id % 5 <> 0""",
        "completed_inputs": _DET + """SELECT event_id, coalesce(fd_name, 'unknown') AS source_ip, coalesce(namespace, 'unknown') AS namespace,
            CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE verb END AS method, CASE WHEN status_code >= 400 THEN 'Failure' ELSE 'Success' END AS result,
            'unknown' AS "user", is_failed FROM det""",
        "scored_documents": _SCO + f"""SELECT CASE WHEN event_type = 'falco' THEN 'falco-alerts' ELSE 'k8s-audit-raw' END AS source_topic, "user", object_type,
            {_RISK} AS risk_level, anomaly_score AS if_score, us, strftime(ts, '%Y-%m-%d') AS day FROM flg""",
        "retention_window": _NORM + "SELECT event_id, us FROM norm WHERE us >= epoch_us(TIMESTAMP '2024-01-13 12:00:00')",
        "log_level_from_text": """WITH d AS (SELECT *, regexp_extract(text, '"([A-Z]+)\\s+(/\\S*)\\s+HTTP/[^"]+"\\s+(\\d{3})', ['m', 'p', 'c']) AS a,
              lower(text) AS t FROM documents),
            e AS (SELECT *, TRY_CAST(a.c AS INT) AS code, CASE WHEN a.c LIKE '5%' THEN 'critical' WHEN a.c LIKE '4%' THEN 'warning'
              WHEN regexp_matches(t, 'critical|panic|fatal') THEN 'critical' WHEN regexp_matches(t, 'error|exception|traceback') THEN 'critical'
              WHEN contains(t, 'warn') THEN 'warning' ELSE 'info' END AS sev FROM d),
            f AS (SELECT *, CASE WHEN code IN (401, 403) THEN 'unauthorized_access' WHEN code BETWEEN 500 AND 599 THEN 'application_server_error'
              WHEN code BETWEEN 400 AND 499 THEN 'application_client_error' WHEN code BETWEEN 200 AND 399 THEN 'application_http_ok'
              WHEN regexp_matches(t, 'traceback|exception|error|fatal|panic') THEN 'application_error_signal'
              WHEN a.m <> '' AND a.m NOT IN ('GET', 'HEAD', 'OPTIONS') THEN 'application_mutation_or_action' ELSE 'application_log' END AS cls FROM e)
            SELECT doc_id, source AS service_name, CASE WHEN cls = 'unauthorized_access' THEN cls ELSE sev END AS severity, cls AS classification,
              CASE WHEN a.m <> '' THEN 'http_request' ELSE 'app_log' END AS event_type, CAST(length(text) AS INT) AS chars FROM f""",
        "slug_of_text": f"""SELECT doc_id, 'falco_' || coalesce(nullif(lower(substr({_SLUG.format('_')}, 1, 96)), ''), 'alert') AS classification,
            coalesce(nullif(lower(substr({_SLUG.format('-')}, 1, 96)), ''), 'alert') AS dashed FROM documents""",
        "fingerprint_dedup": _NORM + "SELECT event_id, us + 3600000000 AS ingest_us FROM norm",
        "noisy_throttle": """WITH RECURSIVE """ + EVENTS_CTE + f""",
            al AS (SELECT event_id, epoch_us(ts) AS us, 'falco_' || lower(replace(rule, ' ', '_')) AS classification FROM det WHERE source_type = 'falco'),
            noisy AS (SELECT * FROM al WHERE classification = 'falco_contact_k8s_api_server_from_container'),
            chain AS (SELECT min(us) AS us FROM noisy UNION ALL
              SELECT (SELECT min(n.us) FROM noisy n WHERE n.us >= chain.us + 21600000000) FROM chain WHERE chain.us IS NOT NULL)
            SELECT event_id, us, classification FROM al WHERE classification <> 'falco_contact_k8s_api_server_from_container'
            UNION ALL SELECT min(event_id), us, min(classification) FROM noisy WHERE us IN (SELECT us FROM chain WHERE us IS NOT NULL) GROUP BY us""",
        "scorer_inputs": _DET + """SELECT event_id, epoch_us(ts) AS us, user_name AS "user", verb AS method, resource AS object_type,
            coalesce(namespace, 'cluster-wide') AS namespace, source_ip, CASE WHEN coalesce(status_code, 200) < 400 THEN 'Success' ELSE 'Failure' END AS result,
            resource_name AS object_name, 'k8s_audit' AS event_type, 'Metadata' AS classification, user_agent AS requesting_service, is_failed
            FROM det WHERE source_type = 'k8s_audit'
            UNION ALL SELECT event_id, epoch_us(ts), user_name, rule, 'runtime_event', coalesce(namespace, 'default'), coalesce(fd_name, 'unknown'),
            'Success', 'pod-' || CAST(user_id % 11 AS VARCHAR), 'falco', priority, coalesce(proc_name, 'unknown'), 0 FROM det WHERE source_type = 'falco'""",
        # runtime rows
        "runtime_actions": _RUN + "SELECT event_id, kind, command, runtime_action, runtime_detail, workload, priority FROM rtr",
        "monitor_records": _RUN + """SELECT r.event_id AS id, 'com.example.monitor.falco.' || CASE WHEN kind = 'falco'
              THEN lower(replace(event_type, ' ', '-')) ELSE 'exec-from-audit' END AS type, us AS time_us, security_relevant AS "securityRelevant",
              workload AS subject, CASE WHEN kind = 'falco' THEN severity ELSE 'invoked-by:' || invoker END AS roles, runtime_action AS request_method,
              runtime_detail AS request_url, CASE WHEN kind = 'falco' THEN event_type ELSE runtime_action END || ': ' || runtime_detail AS requested_call,
              CAST(NULL AS INT) AS destination_port, CASE WHEN coalesce(status_code, 200) < 400 THEN 'Success' ELSE 'Failure' END AS call_result,
              CASE WHEN kind = 'falco' THEN classification ELSE 'falco_exec_from_audit' END AS classification,
              CASE WHEN kind = 'falco' THEN pod_name ELSE resource_name END AS objname,
              CASE WHEN kind = 'falco' THEN 'runtime/' || event_type ELSE 'falco' END AS objtype, CAST(NULL AS BIGINT) AS deleted_us FROM rtr r
            UNION ALL SELECT event_id, CASE WHEN source_type = 'app' THEN 'com.example.monitor.k8s.audit.http.' || lower(coalesce(action, 'unknown'))
              ELSE 'com.example.monitor.k8s.audit.' || resource || coalesce('.' || subresource, '') || '.' || action END, us, security_relevant, effective_user,
              CASE WHEN impersonated IS NOT NULL THEN 'impersonating:' || user_name || ',' || user_group ELSE user_group END,
              upper(coalesce(action, 'unknown')), coalesce(uri, ''), trim(upper(coalesce(action, 'unknown')) || ' ' || coalesce(uri, '')), 6443,
              CASE WHEN coalesce(status_code, 200) < 400 THEN 'Success' ELSE 'Failure' END, classification, resource_name, resource,
              CASE WHEN action = 'delete' THEN completed_us END
            FROM norm WHERE source_type <> 'falco' AND event_no NOT IN (SELECT event_no FROM run)""",
        "alert_stream": _RUN + """SELECT r.event_id, us * 1000 AS ts_ns, lower(replace(runtime_action, ' ', '_')) AS rule, r.priority, iso.stamp AS time
            FROM rtr r JOIN iso ON iso.event_id = r.event_no WHERE classification <> 'falco_contact_k8s_api_server_from_container'""",
        "exec_command": _DET + """SELECT 'a-' || CAST(event_id AS VARCHAR) AS id, CASE WHEN contains(uri, 'command=cat') THEN 'cat /etc/shadow'
              WHEN contains(uri, 'command=uname') THEN 'uname -a' END AS command FROM det WHERE source_type = 'k8s_audit'
            UNION ALL SELECT 'p-' || CAST(page_id AS VARCHAR), nullif(array_to_string(regexp_extract_all(
              replace(split_part(url, '?', 2), '#', '&x='), '(?:page|ref|command)=([^&#]*)', 1), ' '), '') FROM pages""",
        # features
        "feature_hash": _SCO + "SELECT event_id, " + ", ".join(
            f"{_hash(column, n)} AS {name}_hash" for name, column, n in _HASHED) + " FROM flg",
        "event_flags": _SCO + "SELECT event_id, hour, day_of_week, is_off_hours, is_sensitive, is_failed, is_high_risk, is_rbac FROM flg",
        "user_rolling_counts": _ROLL + "SELECT event_id, req_24h, req_7d, req_30d, is_new_user FROM rat",
        "user_rolling_rates": _ROLL + "SELECT event_id, fail_ratio_7d, sensitive_rate_7d FROM rat",
        "user_rolling_distinct": _SCO + "SELECT event_id, " + ", ".join(
            f"{_distinct(chr(34) + 'user' + chr(34), column, 30 * DAY)} AS {name}" for name, column in (
                ("unique_namespaces", "namespace"), ("unique_resources", "object_type"), ("unique_ips", "source_ip"))) + " FROM flg e",
        "user_hour_baseline": _ROLL + "SELECT event_id, user_hour_baseline FROM rat",
        "ip_rolling": _ROLL + f"""SELECT event_id, ip_req_24h, ip_fail_ratio_24h, {_distinct('source_ip', '"user"', DAY)} AS ip_unique_users,
            is_new_ip, fail_burst_5min FROM rat e""",
        "reasons": _ROLL + f""", ips AS (SELECT *, {_distinct('source_ip', '"user"', DAY)} AS ip_unique_users FROM rat e)
            SELECT event_id, """ + _REASON + " AS reason FROM ips",
        "hot_user_rolling": _with(SCO, """hot AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 'system:hot' ELSE "user" END AS "user") FROM flg)""",
            ROLL.replace("FROM flg", "FROM hot")) + "SELECT event_id, req_24h, req_7d, req_30d, fail_ratio_7d, sensitive_rate_7d, "
            "user_hour_baseline, is_new_user, " + ", ".join(
            f"""(SELECT COUNT(DISTINCT h.{column}) FROM hot h WHERE h."user" = e."user" AND h.us >= e.us - {30 * DAY} AND h.us < e.us) AS {name}"""
            for name, column in (("unique_namespaces", "namespace"), ("unique_resources", "object_type"),
                                 ("unique_ips", "source_ip"))) + " FROM rat e",
        "feature_rows": _ROLL + ", d AS (SELECT *, " + ", ".join(
            f"{_distinct(key, column, width)} AS {name}" for name, key, column, width in (
                ("unique_namespaces", '"user"', "namespace", 30 * DAY), ("unique_resources", '"user"', "object_type", 30 * DAY),
                ("unique_ips", '"user"', "source_ip", 30 * DAY), ("ip_unique_users", "source_ip", '"user"', DAY)))
            + " FROM rat e), h AS (SELECT *, " + ", ".join(
            f"{_hash(column, n)} AS {name}_hash" for name, column, n in _HASHED) + " FROM d) SELECT event_id, " + ", ".join(
            f"CAST({value} AS DOUBLE) AS {name}" for name, value in _FEATURES) + " FROM h",
        # scores
        "risk_levels": _SCO + f"""SELECT event_id, {_RISK} AS live,
            CASE WHEN anomaly_score > 0.8 THEN 'HIGH' WHEN anomaly_score > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS training FROM flg""",
        "critical_alerts": _DET + """, m AS (SELECT *, CASE WHEN source_type = 'falco' THEN rule ELSE verb END AS method,
              concat_ws('/', resource, subresource) AS target FROM det)
            SELECT event_id, source_type, method, anomaly_score FROM m WHERE anomaly_score > 0.9 AND anomaly_score >= 0.95 AND CASE WHEN source_type = 'falco'
              THEN regexp_matches(lower(method), 'shell|terminal|passwd|shadow|sensitive|privilege|write below|unexpected')
              ELSE method IN ('delete', 'patch', 'exec', 'create') AND regexp_matches(target, 'secret|rolebinding|pods/exec') END""",
        "human_workload_changes": _SCO + """SELECT event_id, "user", object_type, method FROM flg
            WHERE NOT regexp_matches(lower("user"), 'serviceaccount|system:|bot|ci|pipeline|argo|flux|jenkins|github-actions|automation')
            AND regexp_matches(object_type, 'deployments|pods') AND method IN ('create', 'patch', 'delete')""",
        "combined_scores": _SCO + """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 0.6::DOUBLE * anomaly_score + 0.4::DOUBLE * previous_score
            ELSE anomaly_score END AS combined FROM flg""",
        "training_score_stats": """SELECT count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
            round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.95), 9) AS p95,
            round(quantile_cont(value, 0.99), 9) AS p99 FROM events""",
        "normalized_scores": """SELECT event_id, 1.0::DOUBLE - (value - low) / (high - low) AS score
            FROM events, (SELECT min(value) AS low, max(value) AS high FROM events)""",
        "psi_drift": _with(SCO, _PSI) + "SELECT n_old, n_new, round(psi, 9) AS psi FROM psi",
        "score_day_counts": _SCO + f"""SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (anomaly_score > 0.5) AS n_high, """ + ", ".join(
            f"count(*) FILTER ({_bins('anomaly_score')} = {i}) AS b{i}" for i in range(10)) + " FROM flg WHERE anomaly_score IS NOT NULL GROUP BY 1",
        "drift_over_days": _SCO + f""", d AS (SELECT CAST(ts AS DATE) AS day, {_bins('anomaly_score')} AS b, anomaly_score FROM flg WHERE anomaly_score IS NOT NULL),
            g AS (SELECT day, count(*) AS n, CAST(count(*) FILTER (anomaly_score > 0.5) AS DOUBLE) / count(*) AS rate FROM d GROUP BY day),
            c AS (SELECT g.day, n, rate, b, (SELECT count(*) FROM d WHERE d.day < g.day) AS n_before,
              (SELECT count(*) FROM d WHERE d.day < g.day AND d.b = k.b) AS o, (SELECT count(*) FROM d WHERE d.day = g.day AND d.b = k.b) AS a
              FROM g, (SELECT unnest(range(10)) AS b) k),
            s AS (SELECT *, CASE WHEN o = 0 THEN 0.0001::DOUBLE ELSE CAST(o AS DOUBLE) / n_before END AS old_share,
              CASE WHEN a = 0 THEN 0.0001::DOUBLE ELSE CAST(a AS DOUBLE) / n END AS new_share FROM c WHERE n_before > 0)
            SELECT day, n_before, n, rate, round(sum((new_share - old_share) * ln(new_share / old_share)), 9) AS psi FROM s GROUP BY ALL""",
        "forest_walk": _WALKED + "SELECT event_id, round(raw, 9) AS raw_score FROM raws",
        "scored_events": _WALKED + f"""SELECT event_id, round_even(total, 4) AS anomaly_score, round_even(total, 4) AS if_score,
            CASE WHEN total > 0.9 THEN 'HIGH' WHEN total > 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, {_ROUNDED} AS reason, 'small' AS model_version FROM tot""",
        "alert_texts": _SCO + """, a AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'Terminal opened' ELSE 'request burst' END AS reason FROM flg
              WHERE anomaly_score > 0.9 AND anomaly_score >= 0.95)
            SELECT event_id, concat_ws(chr(10), 'HIGH RISK ALERT', 'Source: ' || event_type, 'User: ' || "user", 'Resource: ' || object_type,
              'Action/Rule: ' || method, 'Score: ' || CAST(anomaly_score AS VARCHAR), 'Reason: ' || reason, '-------------------------') AS alert_record,
              concat_ws(chr(10), '*HIGH Risk Security Alert Detected*', '*Source:* `' || event_type || '`', '*Risk Level:* `HIGH`',
                '*Anomaly Score:* `' || CAST(anomaly_score AS VARCHAR) || '`', '*User:* `' || "user" || '`', '*Source IP:* `' || source_ip || '`',
                '*Namespace:* `' || namespace || '`', '*Resource:* `' || object_type || '`', '*Action / Falco Rule:* `' || method || '`',
                '*Time:* `' || CAST(ts AS VARCHAR) || '`', '*Reason:* ' || reason) AS alert_text
            FROM a WHERE CASE WHEN event_type = 'falco' THEN regexp_matches(lower(method) || ' ' || lower(reason), 'shell|terminal|passwd|shadow|sensitive|privilege|write below|unexpected')
              ELSE method IN ('delete', 'patch', 'exec', 'create') AND regexp_matches(lower(object_type), 'secret|rolebinding|pods/exec|runtime_event') END""",
        "sequence_scale": _SCO + """, w AS (SELECT sum(hour) OVER o AS h, sum(hour * hour) OVER o AS hh, sum(is_failed) OVER o AS f FROM flg
              WINDOW o AS (PARTITION BY "user" ORDER BY us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
            m AS (SELECT CAST(sum(h) AS DOUBLE) / (20 * count(*)) AS h, CAST(sum(hh) AS DOUBLE) / (20 * count(*)) AS hh, CAST(sum(f) AS DOUBLE) / (20 * count(*)) AS f FROM w)
            SELECT 'hour' AS feature, round(h, 6) AS mean, round(sqrt(hh - h * h), 6) AS deviation FROM m
            UNION ALL SELECT 'is_failed', round(f, 6), round(sqrt(f - f * f), 6) FROM m""",
        "model_decision": _with(SCO, _PSI) + """SELECT old_rate, new_rate, round(psi, 9) AS psi, psi > 0.2 AS psi_alert,
            CASE WHEN psi > 0.2 THEN 'replaced with drift' WHEN new_rate > old_rate * 3.0 THEN 'aborted' ELSE 'replaced' END AS decision
            FROM psi, (SELECT CAST(count(*) FILTER (previous_score > 0.5) AS DOUBLE) / count(previous_score) AS old_rate,
              CAST(count(*) FILTER (anomaly_score > 0.5) AS DOUBLE) / count(anomaly_score) AS new_rate FROM flg)""",
        "chronological_split": """SELECT event_id, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) <= floor(n * 0.85) AS is_train
            FROM events, (SELECT count(*) AS n FROM events)""",
        "holdout_split": f"""SELECT event_id, us, us < m - {2 * DAY} AS is_train FROM (SELECT event_id, epoch_us(ts) AS us FROM events),
            (SELECT epoch_us(max(ts)) AS m FROM events) WHERE us >= m - {20 * DAY}""",
        "sequence_window_sums": _SCO + """SELECT event_id, CAST(count(*) OVER w AS INT) AS steps, count(*) OVER w = 20 AS seq_active,
            CAST(sum(hour) OVER w AS DOUBLE) AS hour_sum, CAST(sum(is_failed) OVER w AS DOUBLE) AS failed_sum, 20 AS padded_steps FROM flg
            WINDOW w AS (PARTITION BY "user" ORDER BY us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
        "labelled_events": _SCO + """, l AS (SELECT "user", date_trunc('second', ts) AS s, arg_max(CASE analyst_label WHEN 1 THEN 'anomaly' WHEN 0 THEN 'normal'
              ELSE 'real_unknown' END, event_id) AS label FROM flg GROUP BY ALL)
            SELECT f.event_id, l.label FROM flg f JOIN l ON f."user" = l."user" AND date_trunc('second', f.ts) = l.s WHERE l.label <> 'real_unknown'""",
        "auc_roc": """WITH d AS (SELECT n_chars AS s, quality AS q FROM documents JOIN labels USING (doc_id)),
            r AS (SELECT q, (rank() OVER (ORDER BY s) + (SELECT count(*) FROM d x WHERE x.s = d.s) + rank() OVER (ORDER BY s) - 1) AS rr FROM d),
            t AS (SELECT sum(q) AS p, sum(1 - q) AS n, sum(CASE WHEN q = 1 THEN rr ELSE 0 END) AS w FROM r)
            SELECT CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives,
              CAST(w - p * (p + 1) AS DOUBLE) / (2.0::DOUBLE * CAST(p AS DOUBLE) * CAST(n AS DOUBLE)) AS auc FROM t""",
        "quality_report": """WITH c AS (SELECT count(*) FILTER (s >= 0.5 AND q = 1) AS tp, count(*) FILTER (s >= 0.5 AND q = 0) AS fp,
              count(*) FILTER (s < 0.5 AND q = 1) AS fn, count(*) FILTER (s < 0.5 AND q = 0) AS tn
              FROM (SELECT least(n_chars / 5000.0::DOUBLE, 1.0) AS s, quality AS q FROM documents JOIN labels USING (doc_id)))
            SELECT tp, fp, fn, tn, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS "precision",
              coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM c""",
        # analysts
        "recent_events": _SCO + """SELECT event_id, us, "user", anomaly_score FROM flg ORDER BY us DESC, event_id DESC LIMIT 200""",
        "recent_high_events": _SCO + "SELECT event_id, us, anomaly_score FROM flg WHERE anomaly_score >= 0.9 ORDER BY us DESC, event_id DESC LIMIT 100",
        "digest_all": _SCO + _DIGEST + "flg",
        "digest_24h": _SCO + _DIGEST + f"(SELECT * FROM flg WHERE us >= (SELECT max(us) FROM flg) - {DAY})",
        "digest_top": _SCO + """SELECT event_id, "user", anomaly_score FROM flg WHERE anomaly_score > 0.5
            ORDER BY anomaly_score DESC, us DESC, event_id DESC LIMIT 10""",
        "behaviour_flags": _SCO + """SELECT "user", sum(is_off_hours)::BIGINT AS off_hours_events, count(*) FILTER (anomaly_score > 0.8) AS high_risk_events
            FROM flg GROUP BY "user" HAVING sum(is_off_hours) > 0 AND count(*) FILTER (anomaly_score > 0.8) > 0""",
        "behaviour_profile": _SCO + """, h AS (SELECT "user", hour, count(*) AS n FROM flg GROUP BY ALL),
            b AS (SELECT "user", hour AS most_active_hour FROM h QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY n DESC, hour) = 1)
            SELECT f."user", count(*) AS total_events, min(us) AS first_seen_us, max(us) AS last_seen_us, count(DISTINCT namespace) AS unique_namespaces,
              count(DISTINCT object_type) AS unique_object_types, count(DISTINCT source_ip) AS unique_source_ips, sum(is_failed)::BIGINT AS failed_requests,
              sum(is_sensitive)::BIGINT AS sensitive_accesses, sum(is_off_hours)::BIGINT AS off_hours_events,
              count(*) FILTER (anomaly_score > 0.8) AS high_risk_events,
              count(*) FILTER (anomaly_score > 0.5 AND anomaly_score <= 0.8) AS medium_risk_events, any_value(most_active_hour) AS most_active_hour
            FROM flg f JOIN b ON f."user" = b."user" GROUP BY f."user" """,
        "profile_values": _SCO + " UNION ALL ".join(
            f"""SELECT "user", '{kind}' AS kind, CAST({kind} AS VARCHAR) AS value, count(*) AS events FROM flg GROUP BY ALL"""
            for kind in ("method", "namespace", "object_type", "source_ip", "hour")),
        "profile_examples": _SCO + """SELECT "user", 'off hours' AS example, CAST(p AS INT) AS place, event_id, us, namespace, object_type, method, anomaly_score
              FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY us, event_id) AS p FROM flg WHERE is_off_hours = 1) WHERE p <= 3
            UNION ALL SELECT "user", 'high score', CAST(p AS INT), event_id, us, namespace, object_type, method, anomaly_score
              FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY us DESC, event_id DESC) AS p FROM flg WHERE anomaly_score > 0.8) WHERE p <= 5""",
        "forensics": _SCO + """SELECT event_id, us, "user", source_ip, namespace, object_type, method, is_failed, is_sensitive, anomaly_score FROM flg
            WHERE "user" ILIKE '%user-%' AND object_type ILIKE '%secret%' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'
            AND is_failed = 0 AND anomaly_score >= 0.3 ORDER BY anomaly_score DESC, us DESC, event_id DESC LIMIT 40""",
        "forensics_fallback": _SCO + """SELECT event_id, us, "user", source_ip, namespace, object_type, method, is_failed, is_sensitive, anomaly_score FROM flg
            WHERE anomaly_score >= 0.8 ORDER BY us DESC, event_id DESC LIMIT 50""",
        "actor_rbac_history": _SCO + """SELECT event_id, "user", CAST(p AS INT) AS place, object_type FROM (SELECT *, row_number() OVER (
            PARTITION BY "user" ORDER BY us DESC, event_id DESC) AS p FROM flg WHERE is_rbac = 1) WHERE p <= 5""",
        "label_counts": _SCO + """SELECT count(*) AS total, count(analyst_label) AS labeled,
            count(*) FILTER (analyst_label = 1) AS confirmed_anomalies FROM flg""",
        "verb_over_time": _DET + """SELECT epoch_us(ts) // 300000000 * 300000000 AS start_us, verb, count(*) AS events FROM det
            WHERE source_type = 'k8s_audit' GROUP BY ALL""",
        "verb_sliding": _DET + """SELECT (epoch_us(ts) // 1200000000 - k) * 1200000000 AS start_us, verb, count(*) AS events
            FROM det, (SELECT unnest(range(3)) AS k) WHERE source_type = 'k8s_audit' GROUP BY ALL""",
        "verb_resource_share": _DET + "SELECT verb, resource, count(*) AS events FROM det WHERE source_type = 'k8s_audit' GROUP BY ALL",
        "verb_shares": _DET + """SELECT verb, count(*) AS events, count(*) / (SELECT count(*) FROM det WHERE source_type = 'k8s_audit') AS share
            FROM det WHERE source_type = 'k8s_audit' GROUP BY verb""",
        "resource_shares": _DET + """SELECT resource, count(*) AS events, count(*) / (SELECT count(*) FROM det WHERE source_type = 'k8s_audit') AS share
            FROM det WHERE source_type = 'k8s_audit' GROUP BY resource""",
        "audits_of_verb": _DET + """SELECT event_id, 'list' AS filter FROM det WHERE source_type = 'k8s_audit' AND verb = 'list'
            UNION ALL SELECT event_id, 'all' FROM det WHERE source_type = 'k8s_audit'""",
        "alert_tail": _DET + "SELECT event_id, rule, priority FROM det WHERE source_type = 'falco' ORDER BY ts DESC, event_id DESC LIMIT 50",
        "recent_store": _DET + "SELECT event_id FROM det ORDER BY ts + to_hours(CAST(event_id * 7 % 400 AS INT)) DESC, event_id DESC LIMIT 1000",
        "samples_in_time": _DET + f"SELECT event_id FROM det WHERE event_id * 7 % 400 <= {K.MAX_SAMPLE_AGE_HOURS}",
        "failures_over_time": _DET + """SELECT epoch_us(ts) // 300000000 * 300000000 AS start_us, verb, resource, count(*) AS events FROM det
            WHERE source_type = 'k8s_audit' AND status_code >= 400 GROUP BY ALL""",
        "falco_priority_panels": _DET + """SELECT total, critical, notice, urgent, CASE WHEN urgent >= 20 THEN 'red' WHEN urgent >= 5 THEN 'yellow' ELSE 'green' END AS light
            FROM (SELECT count(*) AS total, count(*) FILTER (priority = 'Critical') AS critical, count(*) FILTER (priority = 'Notice') AS notice,
              count(*) FILTER (priority IN ('Critical', 'Warning')) AS urgent FROM det WHERE source_type = 'falco')""",
        "falco_rate": _DET + """SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, priority, count(*) AS events FROM det
            WHERE source_type = 'falco' GROUP BY ALL""",
        "top_rules": _DET + "SELECT rule, count(*) AS events FROM det WHERE source_type = 'falco' GROUP BY rule ORDER BY events DESC, rule LIMIT 10",
        "top_rules_detail": _DET + """SELECT rule, priority, count(*) AS events FROM det WHERE source_type = 'falco'
            GROUP BY ALL ORDER BY events DESC, rule, priority LIMIT 15""",
        "object_types": _SCO + "SELECT DISTINCT object_type FROM flg",
        "cluster_tree": """WITH p AS (SELECT CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN 'ghost' ELSE r_name END AS node,
              n_name, s_name, CASE WHEN s_acctbal > 0 THEN 'Running' ELSE 'Unknown' END AS phase
              FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
            SELECT CASE WHEN node IS NULL AND s_name IS NOT NULL AND r_name IS NULL THEN 2 WHEN r_regionkey = 0 THEN 0 ELSE 1 END AS node_rank,
              CASE WHEN r_name IS NULL AND node IS NULL THEN '(unscheduled)' ELSE coalesce(r_name, node) END AS node,
              CASE WHEN r_name IS NULL AND node IS NULL THEN 'pending' WHEN r_name IS NULL THEN 'unknown' WHEN r_regionkey = 0 THEN 'control-plane' ELSE 'worker' END AS role,
              n_name AS namespace, s_name AS pod, CASE WHEN s_name IS NULL THEN NULL ELSE '' END AS app, phase
            FROM region FULL OUTER JOIN p ON r_name = node""",
        "pods_by_namespace": """WITH p AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'default' ELSE n_name END AS namespace, s_name AS name
              FROM supplier JOIN nation ON s_nationkey = n_nationkey)
            SELECT namespace, name, count(*) OVER (PARTITION BY namespace) AS pods_in_namespace FROM p""",
        "services_by_namespace": """SELECT CASE WHEN n_regionkey = 0 THEN 'default' ELSE n_name END AS namespace,
              CASE WHEN n_nationkey % 2 = 0 THEN 'kubernetes' ELSE n_name END AS name, 'ClusterIP' AS type FROM nation
            WHERE NOT (n_regionkey = 0 AND n_nationkey % 2 = 0)""",
        "order_counters": """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS pending,
            count(*) FILTER (o_orderstatus = 'F') AS delivered, count(*) FILTER (o_orderstatus = 'O') AS cancelled FROM orders""",
        "user_counters": """SELECT count(*) AS total, count(*) FILTER (c_mktsegment = 'MACHINERY') AS admins,
            count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS customers, count(*) FILTER (c_mktsegment = 'BUILDING') AS vendors FROM customer""",
        "row_validation": """SELECT 'product' AS kind, p_partkey AS id, concat_ws(', ', CASE WHEN length(p_name) NOT BETWEEN 1 AND 200 THEN 'name length' END,
              CASE WHEN NOT p_retailprice - 950 > 0 THEN 'price positive' END, CASE WHEN p_size - 3 < 0 THEN 'quantity not negative' END) AS violations FROM part
            UNION ALL SELECT 'order', o_orderkey, concat_ws(', ', CASE WHEN length(CAST(o_custkey AS VARCHAR)) < 2 THEN 'customer length' END,
              CASE WHEN o_custkey % 3 < 1 THEN 'quantity at least one' END) FROM orders""",
        "user_validation": """SELECT id, v AS violations FROM (SELECT c_custkey AS id, concat_ws(', ', CASE WHEN c_custkey % 12 + 6 NOT BETWEEN 10 AND 15 THEN 'phone length' END,
            CASE WHEN c_custkey % 4 = 0 THEN 'email form' END) AS v FROM customer) WHERE v <> ''""",
        "merge_new_events": _DET + "SELECT event_id AS id, epoch_us(ts) AS time, source_type FROM det",
        "insert_unique": """SELECT email, min(c_custkey) AS c_custkey FROM (SELECT c_custkey, c_mktsegment || CAST(c_nationkey AS VARCHAR) || '@shop' AS email FROM customer)
            WHERE email NOT LIKE 'MACHINERY%' GROUP BY email""",
        "partial_update": """SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 AND c_nationkey < 5 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey,
            CASE WHEN c_acctbal < 0 THEN 'BLOCKED' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
        "customer_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 40",
        "order_defaults": "SELECT o_orderkey AS id, '' AS customer, 0 AS quantity, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE 'Pending' END AS status FROM orders",
        # documented investigations
        "uc_daily_summary": _SCO + f"""SELECT us // {DAY} AS day, count(*) AS events, count(DISTINCT "user") AS actors,
            count(DISTINCT "user") FILTER (s) AS service_actors, count(DISTINCT "user") FILTER (NOT s) AS human_actors, sum(is_failed)::BIGINT AS failed
            FROM (SELECT *, regexp_matches("user", '^system:|serviceaccount|bot') AS s FROM flg) GROUP BY 1""",
        "uc_read_bursts": _SCO + f""", s AS (SELECT "user", us // 43200000000 AS slot, count(*) AS calls FROM flg
              WHERE regexp_matches(object_type, 'secret|configmap') AND method IN ('get', 'list') GROUP BY ALL),
            b AS (SELECT *, slot * 43200000000 // {DAY} AS day FROM s)
            SELECT "user", start_us, calls, CAST(base AS BIGINT) AS baseline_calls FROM (SELECT "user", slot * 43200000000 AS start_us, calls,
              (SELECT coalesce(sum(h.calls), 0) FROM b h WHERE h."user" = b."user" AND h.day >= b.day - 7 AND h.day < b.day) AS base FROM b)
            WHERE calls >= 2 AND calls * 7 > base * 2""",
        "uc_session_bursts": _SCO + """, g AS (SELECT "user", us, CASE WHEN us - lag(us) OVER w < 21600000000 THEN 0 ELSE 1 END AS s FROM flg
              WINDOW w AS (PARTITION BY "user" ORDER BY us, event_id)),
            r AS (SELECT "user", us, sum(s) OVER (PARTITION BY "user" ORDER BY us, s DESC ROWS UNBOUNDED PRECEDING) AS run FROM g)
            SELECT "user", min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS events FROM r GROUP BY "user", run HAVING count(*) >= 3""",
        "uc_change_window": _SCO + """SELECT event_id, "user", object_type, hour FROM flg
            WHERE contains(object_type, 'role') AND method IN ('create', 'patch', 'delete') AND (hour < 8 OR hour >= 18)""",
        "uc_repeat_exec": _SCO + """, e AS (SELECT *, count(*) OVER (PARTITION BY "user", namespace ORDER BY us RANGE BETWEEN 259200000000 PRECEDING AND 1 PRECEDING) AS b
              FROM flg WHERE object_type LIKE '%/exec')
            SELECT event_id, us, "user", namespace, 'any' AS target, b + 1 AS calls FROM e WHERE b + 1 >= 2""",
        "uc_first_permission_change": _SCO + f""", e AS (SELECT "user", us, lag(us) OVER (PARTITION BY "user" ORDER BY us) AS previous_us FROM flg
              WHERE contains(object_type, 'role') AND method IN ('create', 'patch', 'delete'))
            SELECT "user", us, previous_us FROM e WHERE previous_us IS NULL OR us - previous_us > {4 * DAY}""",
        "uc_first_secret_access": _SCO + f""", e AS (SELECT "user", namespace, target, us, lag(us) OVER (PARTITION BY "user", namespace, target ORDER BY us) AS previous_us
              FROM flg WHERE contains(object_type, 'secret'))
            SELECT "user", namespace, target, us, previous_us FROM e WHERE previous_us IS NULL OR us - previous_us > {3 * DAY}""",
        "uc_drift": """WITH o AS (SELECT *, p_partkey % 13 <> 5 AS seen FROM part),
            d AS (SELECT p_partkey, 'p_brand' AS field, p_brand AS approved, CASE WHEN seen THEN CASE WHEN p_partkey % 10 = 0 THEN 'Brand#X' ELSE p_brand END END AS observed FROM o
              UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR), CASE WHEN seen AND p_partkey % 15 <> 0 THEN CAST(p_size AS VARCHAR) END FROM o
              UNION ALL SELECT p_partkey, 'p_type', p_type, CASE WHEN seen THEN p_type END FROM o)
            SELECT * FROM d WHERE approved IS DISTINCT FROM observed""",
        "uc_403_spikes": _SCO + f""", s AS (SELECT source_ip, us // {DAY} AS slot, count(*) AS denials FROM flg WHERE status_code IN (401, 403) GROUP BY ALL),
            w AS (SELECT *, count(*) OVER e AS n, sum(denials) OVER e AS t, sum(denials * denials) OVER e AS q FROM s
              WINDOW e AS (PARTITION BY source_ip ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            v AS (SELECT *, CAST(t AS DOUBLE) / n AS mean, CAST(q AS DOUBLE) / n - (CAST(t AS DOUBLE) / n) * (CAST(t AS DOUBLE) / n) AS var FROM w),
            z AS (SELECT *, CASE WHEN n > 0 AND var > 0 THEN round((denials - mean) / sqrt(var), 6) END AS z FROM v)
            SELECT source_ip, slot * {DAY} AS start_us, denials, z FROM z WHERE denials >= 2 AND (z IS NULL OR z > 1.0)""",
        "uc_unfamiliar_agents": _SCO + """SELECT a."user", user_agent, first_us FROM (SELECT "user", user_agent, min(us) AS first_us FROM flg GROUP BY ALL) a
            JOIN (SELECT "user", min(us) AS s FROM flg GROUP BY "user") k ON a."user" = k."user" WHERE first_us > s""",
    }
