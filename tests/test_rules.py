"""One row per branch of the ordered rules, and values with a known answer."""

import hashlib
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.functions import rules as R
from eventwarden.functions import timestamps as T
from eventwarden.functions.hashing import fingerprint, hash_bucket
from eventwarden.functions.text import lookup, plain_label, slug
from eventwarden.operators import policy as P
from eventwarden.operators import runtime as RT
from eventwarden.operators.normalize import normalize_events, open_envelope, parse_access_lines, quarantine
from eventwarden.operators.tagging import tag_events
from eventwarden.plans.features import with_event_flags


def one(spark, column, **values):
    row = spark.range(1).select(*[
        (v if hasattr(v, "cast") else F.lit(v)).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("code,user,verb,resource,sub,message,want", [
    (403, "system:node:a", "delete", "pods", None, "", "kubelet_routine"),
    (200, "System:Node:a", "create", "serviceaccounts", "token", "", "kubelet_routine"),
    (200, "system:node:a", "patch", "nodes", "status", "", "kubelet_status_reconciliation"),
    (401, "u", "get", "pods", "exec", "", "unauthorized_access"),
    (200, "u", "get", "pods", None, "access Forbidden", "unauthorized_access"),
    (200, "u", "create", "pods", "attach", "", "exec_access"),
    (200, "u", "exec", "pods", None, "", "exec_access"),
    (200, "u", "get", "secrets", None, "uri=/x/portforward", "exec_access"),
    (200, "u", "patch", "rolebindings", None, "", "rbac_change"),
    (200, "u", "delete", "secrets", None, "", "secret_access"),
    (200, "u", "get", "rolebindings", None, "", "normal_operation"),
    (200, "u", "create", "serviceaccounts", None, "", "privilege_escalation_candidate"),
    (200, "u", "delete", "namespaces", None, "", "destructive_change"),
    (200, "u", "update", "configmaps", None, "", "config_change"),
    (200, "u", "get", "validatingwebhookconfigurations", None, "", "admission_webhook_change"),
    (None, None, None, None, None, None, "normal_operation"),
])
def test_audit_classification(spark, code, user, verb, resource, sub, message, want):
    found = one(spark, R.audit_classification(*[F.col(c) for c in ("c", "v", "r", "s", "m", "u")]),
                c=F.lit(code).cast("int"), v=F.lit(verb).cast("string"), r=F.lit(resource).cast("string"),
                s=F.lit(sub).cast("string"), m=F.lit(message).cast("string"), u=F.lit(user).cast("string"))
    assert found == want


@pytest.mark.parametrize("code,want", [
    (None, "info"), (401, "unauthorized_access"), (101, "critical"), (204, "info"), (302, "info"),
    (404, "warning"), (503, "critical")])
def test_severity_from_status(spark, code, want):
    assert one(spark, R.severity_from_status(F.col("c")), c=F.lit(code).cast("int")) == want


@pytest.mark.parametrize("word,level,priority", [
    ("", "info", "warning"), ("DEBUG", "info", "info"), (" Warn ", "warning", "warning"),
    ("Error", "critical", "critical"), ("panic", "critical", "warning"), ("what", "info", "warning"),
    ("Informational", "info", "info"), (None, "info", "warning")])
def test_severity_words(spark, word, level, priority):
    text = F.lit(word).cast("string")
    assert one(spark, R.severity_from_level(F.col("w")), w=text) == level
    assert one(spark, R.severity_from_priority(F.col("w")), w=text) == priority


@pytest.mark.parametrize("rule,want", [
    ("Terminal shell in container", "falco_terminal_shell_in_container"), ("  ", "falco_falco_alert"),
    (None, "falco_falco_alert"), ("--", "falco_alert"), ("K8S/API", "falco_k8s_api"),
    ("x" * 200, "falco_" + "x" * 96)])
def test_falco_classification(spark, rule, want):
    assert one(spark, R.falco_classification(F.col("r")), r=F.lit(rule).cast("string")) == want


@pytest.mark.parametrize("command,path,process,message,rule,want", [
    ("cat /etc/shadow", None, None, "", "x", "Read sensitive file"),
    (None, "/root/.aws/credentials", None, "", "x", "Searched cloud credentials"),
    (None, "/home/a/.ssh/id", None, "", "x", "Read SSH information"),
    ("touch x", "/etc/motd", None, "", "x", "Wrote under etc"),
    ("python a", "/usr/local/bin/python", "python", "", "x", "Runtime security alert"),
    ("cp a b", "/sbin/b", None, "", "x", "Wrote binary directory"),
    ("apk add nmap", None, None, "", "x", "Ran package manager"),
    (None, None, "zsh", "", "x", "Spawned interactive shell"),
    ("python sh -c ls", None, None, "", "x", "Spawned interactive shell"),
    ("uname -r", None, None, "", "x", "Collected system information"),
    ("cat /etc/hosts", None, None, "", "x", "Read sensitive file"),
    (None, "a->10.96.3.1:443", None, "", "x", "Contacted Kubernetes API"),
    (None, None, None, "connect 10.96.0.1", "x", "Contacted Kubernetes API"),
    (None, None, None, "", " Clear Log Activities ", "Cleared log activities"),
    (None, None, None, "", "my netcat thing", "Netcat remote execution"),
])
def test_runtime_action(spark, command, path, process, message, rule, want):
    values = dict(r=rule, m=message, c=command, p=path, q=process)
    cols = {k: F.lit(v).cast("string") for k, v in values.items()}
    assert one(spark, RT.action_label(*[F.col(k) for k in values]), **cols) == want


@pytest.mark.parametrize("uri,message,body,want", [
    ("/a/exec?command=cat&command=%2Fetc%2Fpasswd", None, None, "cat /etc/passwd"),
    ("/a/exec?command=a+b&x=1&command=c%252Bd#command=z", None, None, "a b c+d"),
    ("/a/log?command=cat", "m uri=/q?command=ls next", None, "ls"),
    ("/a/exec?x=1", None, '{"command": ["sh", "-c"]}', "sh -c"),
    (None, None, '{"commands": " top "}', "top"),
    (None, None, None, None),
])
def test_exec_command(spark, uri, message, body, want):
    cols = {k: F.lit(v).cast("string") for k, v in dict(u=uri, m=message, b=body).items()}
    assert one(spark, RT.exec_command(F.col("u"), F.col("m"), F.col("b")), **cols) == want


def test_action_detail_and_lookup(spark):
    fields = F.create_map(*[F.lit(x) for x in ("a", " ", "b", "<NA>", "c", " v ")])
    assert one(spark, lookup(F.col("f"), "a", "b", "c"), f=fields) == "v"
    long = "x" * 170
    found = one(spark, RT.action_detail(F.lit("r"), F.lit("m"), F.lit(long), F.lit("/p"), F.lit("sh")))
    assert found == "x" * 157 + "... | /p | process=sh"
    none = F.lit(None).cast("string")
    assert one(spark, RT.action_detail(F.lit("r"), F.lit(" "), none, none, none)) == "r"


@pytest.mark.parametrize("action,severity,want", [
    ("Read sensitive file", "info", "Critical"), ("Container exec", "critical", "Notice"),
    ("Cleared log activities", "unauthorized_access", "Critical"), ("Other", "warn", "Warning"), ("Other", None, "Notice")])
def test_action_priority(spark, action, severity, want):
    assert one(spark, RT.action_priority(F.lit(action), F.lit(severity).cast("string"))) == want


@pytest.mark.parametrize("value", ["alice", "", "10.0.0.1", "système", "x" * 300])
@pytest.mark.parametrize("buckets", [100, 500, 2000, 5000, 10_000])
def test_hash_bucket(spark, value, buckets):
    want = int(hashlib.md5(value.encode()).hexdigest(), 16) % buckets
    assert one(spark, hash_bucket(F.col("v"), buckets), v=value) == want


@pytest.mark.parametrize("stamp,text", [
    ("2024-01-02 03:04:05", "2024-01-02T03:04:05+00:00"),
    ("2024-01-02 03:04:05.000120", "2024-01-02T03:04:05.000120+00:00")])
def test_fingerprint(spark, stamp, text):
    message = 'say "hé" \\ tab\t'
    want = hashlib.sha256(json.dumps({
        "action": None, "event_type": "t", "message": message, "namespace": None, "pod_name": None,
        "resource": None, "resource_name": None, "service_name": None, "severity": "info",
        "source_type": "app", "status_code": 200, "tags": [], "timestamp": text, "user_name": None,
    }, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    found = one(spark, fingerprint(F.lit(stamp).cast("timestamp"), event_type=F.lit("t"), message=F.lit(message),
                                   severity=F.lit("info"), source_type=F.lit("app"), status_code=F.lit(200)))
    assert found == want


@pytest.mark.parametrize("text,want", [
    ("2026-04-01T02:17:43Z", "2026-04-01T02:17:43+00:00"),
    ("2026-04-01 02:17:43.123456+00:00", "2026-04-01T02:17:43.123456+00:00"),
    ("2026-04-01T02:17:43+02:00", "2026-04-01T00:17:43+00:00"),
    ("Wed, 01 Apr 2026 02:17:43 GMT", "2026-04-01T02:17:43+00:00"),
    ("01/Apr/2026:02:17:43 +0000", "2026-04-01T02:17:43+00:00"),
    ("2026", None), ("soon", None), ("", None), (None, None)])
def test_parse_text(spark, text, want):
    assert one(spark, T.iso_text(T.parse_text(F.col("t"))), t=F.lit(text).cast("string")) == want


def test_parse_epoch(spark):
    assert one(spark, T.iso_text(T.parse_epoch(F.lit(1_700_000_000.5)))) == "2023-11-14T22:13:20.500000+00:00"
    assert one(spark, T.iso_text(T.parse_epoch(F.lit(1_700_000_000_500)))) == "2023-11-14T22:13:20.500000+00:00"


def test_slugs(spark):
    assert one(spark, slug(F.lit("  Read (ssh) info! "), "alert", "-")) == "read-ssh-info"
    assert one(spark, slug(F.lit("!!"), "alert")) == "alert"
    assert one(spark, plain_label(F.lit("Write below etc"))) == "write_below_etc"


@pytest.mark.parametrize("hour,off", [(5, 1), (6, 0), (20, 0), (21, 1)])
def test_off_hours(spark, hour, off):
    row = spark.range(1).select(
        F.lit(f"2024-01-01 {hour:02d}:30:00").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("user"),
        F.lit(" ip ").alias("source_ip"), F.lit("").alias("namespace"), F.lit("Pods/Exec").alias("object_type"),
        F.lit("GET").alias("method"), F.lit("e").alias("event_type"), F.lit(0).alias("is_failed"))
    found = with_event_flags(row).first()
    assert (found.is_off_hours, found.hour, found.day_of_week) == (off, hour, 0)
    assert (found.user, found.source_ip, found.namespace, found.is_sensitive) == ("unknown", "ip", "", 1)


@pytest.mark.parametrize("source,namespace,code,cls,default,listed", [
    ("falco", "kube-system", None, "x", True, True),
    ("k8s_audit", "kube-system", 200, "x", False, False),
    ("k8s_audit", "kube-system", 403, "x", True, True),
    ("k8s_audit", "kube-system", 200, "unauthorized_access", True, True),
    ("app", "kube-system", 403, "unauthorized_access", False, False),
    ("app", None, 200, "x", True, False),
    ("app", "prod", 200, "x", True, True),
])
def test_namespace_policy(spark, source, namespace, code, cls, default, listed):
    inputs = (F.lit(source), F.lit(namespace).cast("string"), F.lit(code).cast("int"), F.lit(cls))
    assert one(spark, P.is_kept(*inputs)) is default
    assert one(spark, P.is_kept(*inputs, allowed=["prod"])) is listed


@pytest.mark.parametrize("verb,group,resource,sub,groups,level", [
    ("create", "rbac.authorization.k8s.io", "roles", None, [], "RequestResponse"),
    ("create", "", "roles", None, [], "Metadata"),
    ("watch", "", "secrets", None, [], "RequestResponse"),
    ("create", "", "serviceaccounts", "token", [], "RequestResponse"),
    ("get", "", "pods", "exec", [], "Request"),
    ("delete", "", "pods", None, [], "Metadata"),
    ("list", "", "events", None, [], "None"),
    ("get", "", "nodes", None, ["system:nodes"], "None"),
    ("get", "", "things", None, [], "None"),
    ("patch", "x", "things", None, [], "Metadata"),
])
def test_audit_policy(spark, verb, group, resource, sub, groups, level):
    decision = P.audit_policy(F.lit(verb), F.lit(group), F.lit(resource), F.lit(sub).cast("string"),
                              F.array(*[F.lit(g) for g in groups]).cast("array<string>"))
    assert one(spark, decision)["level"] == level


def test_messages_survive_or_go_to_quarantine(spark):
    lines = [
        '{"source_type":"k8s_audit","event":{"verb":"get","responseStatus":{"code":"x"}}}',
        '{"source_type":"k8s_audit","event":{"auditID":"1","verb":"get","requestReceivedTimestamp":"2024-01-01T00:00:00Z",'
        '"impersonatedUser":{"username":"boss"},"user":{"username":"u","groups":["g"]},"sourceNamespace":"a",'
        '"objectRef":{"namespace":"b","resource":"pods"}}}',
        '{"auditID":"2","verb":"list"}',
        '{"source_type":"app","event":{"status_code":200}}',
        '{"source_type":"falco","event":{"rule":"R","k8s":{"k8s.ns.name":"n"},"output_fields":{"proc.name":"p","k8s.pod.name":"x"},'
        '"fields":{"k8s.pod.name":"y"}}}',
        '{"source_type":"other","event":{"a":1}}',
        "not json",
    ]
    items = open_envelope(spark.createDataFrame([(x,) for x in lines], "value string"))
    events = {r.event_id if r.source_type != "falco" else "f": r for r in tag_events(normalize_events(items)).collect()}
    assert set(events) == {"1", "2", "f"}
    assert (events["1"].effective_user, events["1"].is_impersonated, events["1"].user_groups) == ("boss", True, ["g"])
    assert events["1"].tags == ["classification:normal_operation", "cross-namespace"]
    assert (events["f"].namespace, events["f"].pod_name, events["f"].resource_name) == ("n", "y", "p")
    assert sorted(r.problem for r in quarantine(items).collect()) == [
        "message missing", "unknown source", "unreadable", "unreadable"]


def test_access_lines(spark):
    rows = spark.createDataFrame([
        ("user-service-1", "c1", 'x "GET /a/b HTTP/1.1" 503 y'), ("order-service", "c2", "Fatal: boom"),
        ("order-service", "c3", "warned"), (None, "c4", "fine")], "container_name string, container_id string, message string")
    found = {r.pod_name: r for r in normalize_events(parse_access_lines(rows)).collect()}
    assert (found["c1"].action, found["c1"].resource_name, found["c1"].status_code, found["c1"].severity) == (
        "GET", "/a/b", 503, "critical")
    assert found["c2"].classification == "application_error_signal"
    assert found["c3"].severity == "warning"
    assert found["c4"].service_name == "unknown-service"


def test_human_changes(spark):
    def flag(user, strict):
        return one(spark, R.is_human_workload_change(F.lit(user), F.lit("pods"), F.lit("delete"), strict))
    assert flag("alicia", False) is False
    assert flag("alicia", True) is True
    assert flag("ci-runner", True) is False
    assert flag("jane", False) is True


def test_event_times(spark):
    from eventwarden.operators.normalize import normalize_events, quarantine

    times = {"1700000000": "2023-11-14T22:13:20+00:00", "1700000000123": "2023-11-14T22:13:20.123000+00:00",
             '"2024-01-01T00:00:00Z"': "2024-01-01T00:00:00+00:00", "null": "2020-02-02T00:00:00+00:00", '"soon"': None}
    items = spark.createDataFrame(
        [("app", f'{{"event_id":"{n}","message":"m","timestamp":{t}}}') for n, t in enumerate(times)], "source_type string, body string",
    ).withColumn("ingest_ts", F.expr("timestamp'2020-02-02 00:00:00'"))
    got = {int(r.event_id): r.t for r in normalize_events(items).select("event_id", T.iso_text(F.col("timestamp")).alias("t")).collect()}
    assert got == {n: t for n, t in enumerate(times.values()) if t}
    assert [r.problem for r in quarantine(items).collect()] == ["unreadable time"]
