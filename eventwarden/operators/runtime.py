"""Runtime actions, monitor records and alert log streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.functions.rules import is_exec, status_result
from eventwarden.functions.text import (
    contains_any, first_match, lookup, lower_or_empty, slug, starts_with_any,
)
from eventwarden.functions.timestamps import epoch_ns, iso_text
from eventwarden.operators.pinned import with_all_pinned, with_pinned

def _none() -> Column:
    return F.lit(None).cast("string")


def _given(text: Column) -> Column:
    """An empty text counts as missing."""
    return F.nullif(text, F.lit(""))


def action_label(rule: Column, message: Column, command: Column, path: Column, process: Column) -> Column:
    """What happened: by command and path first, then by rule name."""
    return _label(**_folded(rule, message, command, path, process))


def _folded(rule: Column, message: Column, command: Column, path: Column, process: Column) -> dict[str, Column]:
    """What the labels are searched in, in lower case."""
    cmd, file = lower_or_empty(command), lower_or_empty(path)
    return {"cmd": cmd, "file": file, "proc": lower_or_empty(process), "name": F.trim(lower_or_empty(rule)),
            "hay": F.concat(cmd, F.lit(" "), file, F.lit(" "), lower_or_empty(message))}


def _label(cmd: Column, file: Column, proc: Column, name: Column, hay: Column) -> Column:
    writes_etc = file.startswith("/etc/") & contains_any(cmd, K.ETC_WRITE_COMMANDS)
    writes_bin = starts_with_any(file, K.BINARY_DIRS) & contains_any(cmd, K.BINARY_WRITE_COMMANDS)
    seen = first_match([
        (contains_any(hay, K.SHADOW_FILES), "Read sensitive file"),
        (contains_any(hay, K.CREDENTIAL_PATHS), "Searched cloud credentials"),
        (contains_any(hay, K.SSH_PATHS), "Read SSH information"),
        (contains_any(hay, K.ETC_WRITE_SIGNS) | writes_etc, "Wrote under etc"),
        (contains_any(cmd, K.BINARY_WRITE_SIGNS) | writes_bin, "Wrote binary directory"),
        (contains_any(cmd, K.PACKAGE_COMMANDS), "Ran package manager"),
        (proc.isin(*K.SHELLS) | cmd.contains(" sh -c") | cmd.startswith("sh "),
         "Spawned interactive shell"),
        (cmd.contains("uname"), "Collected system information"),
        (cmd.contains("cat ") & cmd.contains("/etc/"), "Read sensitive file"),
        (file.contains(":443") & file.contains("10.96."), "Contacted Kubernetes API"),
        (hay.contains("connect") & hay.contains("10.96.0.1"), "Contacted Kubernetes API"),
    ], None)
    exact = F.create_map(*[F.lit(x) for pair in K.ACTION_BY_RULE.items() for x in pair])
    hinted = first_match([(name.contains(h), label) for h, label in K.ACTION_BY_HINT], None)
    return F.coalesce(seen, F.try_element_at(exact, name), hinted, F.lit(K.DEFAULT_ACTION))


def action_detail(rule: Column, message: Column, command: Column, path: Column, process: Column) -> Column:
    """Command, path and process behind an alert, without repeating a part."""
    short = F.when(F.length(command) <= 160, command).otherwise(
        F.concat(F.substring(command, 1, 157), F.lit("...")))
    cmd = F.coalesce(command, F.lit(""))
    parts = F.concat_ws(
        " | ", short, F.when(~F.contains(cmd, path), path),
        F.when(~F.contains(cmd, process), F.concat(F.lit("process="), process)))
    fallback = F.coalesce(_given(F.trim(message)), rule)
    return F.substring(F.coalesce(_given(parts), fallback), 1, 512)


def workload_label(namespace: Column, pod: Column, *otherwise: Column) -> Column:
    ns, name = _given(namespace), _given(pod)
    return F.coalesce(F.when(ns.isNotNull() & name.isNotNull(), F.concat(ns, F.lit("/"), name)),
                      name, ns, *otherwise)


def _commands_in(uri: Column) -> Column:
    query = F.regexp_extract_all(uri, F.lit(r"[?&]command=([^&#]*)"), F.lit(1))
    # The query decodes once, the command itself once more without plus signs.
    words = F.transform(query, lambda w: F.try_url_decode(
        F.replace(F.try_url_decode(w), F.lit("+"), F.lit("%2B"))))
    return _given(F.trim(F.array_join(words, " ")))


def exec_command(uri: Column, message: Column, request_object: Column) -> Column:
    """The command of an exec request, from its URI, message or request body."""
    from_uri = F.when(uri.contains("/exec"), _commands_in(uri))
    from_message = _commands_in(F.regexp_extract(message, r"uri=(\S+)", 1))
    bodies = []
    for key in ("command", "commands"):
        body = F.get_json_object(request_object, f"$.{key}")
        listed = F.array_join(F.from_json(body, "array<string>"), " ")
        bodies.append(_given(F.trim(F.when(body.startswith("["), listed).otherwise(body))))
    return F.coalesce(from_uri, from_message, *bodies)


def is_exec_audit(classification: Column, subresource: Column, uri: Column, message: Column) -> Column:
    text = F.coalesce(_given(uri), message)
    return (F.coalesce(classification, F.lit("")) == "exec_access") | is_exec(subresource, text)


def action_priority(action: Column, severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.ACTION_PRIORITY.items() for x in pair])
    level = F.trim(lower_or_empty(severity))
    by_severity = first_match([
        (level.isin("critical", "unauthorized_access", "error", "fatal"), "Critical"),
        (level.isin("warning", "warn"), "Warning"),
    ], "Notice")
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(action))), by_severity)


def with_runtime_columns(events: DataFrame) -> DataFrame:
    """Mark how each event is shown and add its action, detail and workload."""
    e = F.col
    fields = F.coalesce(e("fields"), F.create_map().cast("map<string,string>"))
    exec_like = is_exec_audit(e("classification"), e("subresource"), e("request_uri"), e("message"))
    kind = first_match([
        (e("source_type") == "falco", "falco"),
        ((e("source_type") == "k8s_audit") & exec_like, "exec"),
    ], "audit")
    rows = with_pinned(events, "kind", kind)
    rows = rows.where((e("kind") != "exec")
                      | F.trim(F.coalesce("stage", F.lit(""))).isin("", "ResponseComplete"))
    is_falco = e("kind") == "falco"
    # Long rules are pinned one after the other: generated methods stay small, and a rule is worked out once per row.
    rows = with_all_pinned(rows, {"command": F.when(
        is_falco, lookup(fields, "proc.cmdline", "command")).when(
        e("kind") == "exec", exec_command(
            e("request_uri"), e("message"), F.get_json_object("raw_event", "$.requestObject")))})
    path = F.when(is_falco, lookup(fields, "fd.name", "file", "evt.arg.data"))
    shown_path = F.when(is_falco, lookup(fields, "fd.name", "file"))
    process = F.when(is_falco, lookup(fields, "proc.name", "process")).otherwise(
        F.split_part(e("command"), F.lit(" "), F.lit(1)))
    rule = F.when(is_falco, e("event_type")).otherwise("exec")
    said = F.when(is_falco, e("message")).otherwise(e("command"))
    # The searched texts first, as the label reads each of them many times.
    folded = _folded(rule, said, e("command"), path, process)
    rows = with_all_pinned(rows, {f"_{name}": value for name, value in folded.items()})
    label = _label(**{name: e(f"_{name}") for name in folded})
    ns = F.coalesce(_given(e("namespace")), F.when(is_falco, F.try_element_at(fields, F.lit("k8s.ns.name"))))
    pod = F.when(is_falco, F.coalesce(_given(e("pod_name")), F.try_element_at(fields, F.lit("k8s.pod.name")))
                 ).otherwise(e("resource_name"))
    invoker = F.coalesce(_given(e("effective_user")), _given(e("user_name")), F.lit("unknown"))
    proc_name = F.coalesce(*[_given(F.try_element_at(fields, F.lit(k))) for k in ("proc.name", "proc.exepath")])
    place = F.when(is_falco, workload_label(ns, pod, proc_name, F.lit("container"))
                   ).otherwise(workload_label(ns, pod, invoker))
    runtime_user = F.when(is_falco, lookup(fields, "user.name", "user"))
    rows = with_all_pinned(rows, {
        "runtime_action": F.when(e("kind") == "audit", _none()).when(
            (e("kind") == "exec") & e("command").isNull(), "Container exec").otherwise(label),
        "runtime_detail": F.when(is_falco, action_detail(rule, said, e("command"), shown_path, process)).when(
            e("kind") == "exec", F.coalesce(e("command"), _given(e("request_uri")),
                                            _given(e("message")), F.lit("exec"))),
        "workload": F.concat_ws(" · ", place, runtime_user),
        "invoker": invoker,
        "shown_namespace": ns,
        "shown_pod": pod,
    })
    return rows.drop(*[f"_{name}" for name in folded])


def monitor_events(events: DataFrame, source_urn: str = "urn:k8s:cluster:prod-cluster-01",
                   type_prefix: str = "com.example.monitor",
                   data_schema: str = "urn:example:security:audit:schema:v1") -> DataFrame:
    """Security events as CloudEvents-shaped records.

    Exec requests in the audit log are shown like runtime alerts, once per request.
    """
    rows = with_runtime_columns(events)
    c = F.col
    kind = c("kind")

    def pick(falco: Column, exec_: Column, audit: Column) -> Column:
        return F.when(kind == "falco", falco).when(kind == "exec", exec_).otherwise(audit)

    result = status_result(F.when(c("status_code") != 0, c("status_code")))
    rule = c("event_type")
    falco_perm = F.concat(F.lit("falco:"), rule)
    exec_perm = F.lit("falco:exec-from-audit")
    invoked_by = F.concat(F.lit("invoked-by:"), c("invoker"))
    verb = F.lower(F.coalesce(_given(c("action")), F.lit("unknown")))
    url = F.coalesce(_given(c("request_uri")), c("resource_name"), F.lit(""))
    resource = F.coalesce(_given(c("resource")), F.lit("resource"))
    sub = F.coalesce(c("subresource"), F.lit(""))
    groups = _given(F.array_join("user_groups", ","))
    asserted = F.when(
        c("is_impersonated") & _given(c("user_name")).isNotNull(),
        F.concat_ws(",", F.concat(F.lit("impersonating:"), c("user_name")), groups)).otherwise(groups)
    user = F.coalesce(_given(c("effective_user")), _given(c("user_name")))
    detail = c("runtime_detail")
    container = F.coalesce(_given(c("resource_name")), F.try_element_at("fields", F.lit("container.name")))
    started = F.coalesce(c("invocation_time"), c("timestamp"))
    ended = F.coalesce(c("completion_time"), c("timestamp"))
    shown_class = pick(c("classification"), F.lit("falco_exec_from_audit"), c("classification"))
    falco_stage = F.coalesce(_given(F.trim(F.get_json_object("raw_event", "$.source"))), F.lit("runtime"))
    fd = F.coalesce(*[_given(F.try_element_at("fields", F.lit(k))) for k in ("fd.name", "fd.sip")])
    in_runtime = kind != "audit"

    source = F.struct(
        F.when(in_runtime, c("workload")).otherwise(user).alias("subject"),
        F.when(in_runtime, c("workload")).otherwise(F.coalesce(_given(c("user_uid")), user)).alias("user"),
        pick(c("severity"), invoked_by, asserted).alias("requestRoles"),
        pick(falco_perm, exec_perm, c("derived_privileges")).alias("requestPrivileges"),
        F.when(in_runtime, "falco").otherwise(c("user_agent")).alias("requestingService"),
        F.when(in_runtime, c("runtime_action")).otherwise(F.upper(verb)).alias("requestMethod"),
        F.when(in_runtime, F.substring(detail, 1, 512)).otherwise(url).alias("requestUrl"),
        pick(fd, F.get("source_ips", F.lit(0)), F.get("source_ips", F.lit(0))).alias("requestSource"),
        F.lit(None).cast("int").alias("requestPort"),
    )
    brief = F.substring(detail, 1, 280)
    destination = F.struct(
        pick(F.concat(rule, F.lit(": "), brief), F.concat(c("runtime_action"), F.lit(": "), brief),
             F.trim(F.concat(F.upper(verb), F.lit(" "), url))).alias("requestedCall"),
        F.when(in_runtime, "container-runtime").otherwise("kube-apiserver").alias("destination"),
        F.when(~in_runtime, F.lit(6443)).alias("destinationPort"),
        F.when(~in_runtime, F.lit("TCP")).alias("l4protocol"),
        F.when(~in_runtime, F.lit("TLS")).alias("protocolBinding"),
        F.when(~in_runtime, F.lit("TLS 1.3")).alias("encryption"),
        F.when(in_runtime, "falco").otherwise("kube-apiserver").alias("destinationService"),
        _none().alias("destinationUserRoles"),
        _none().alias("destinationUserPrivs"),
        F.when(~in_runtime, _given(c("api_group"))).alias("apiGroup"),
    )
    network = F.struct(
        F.when(in_runtime, "container-runtime").otherwise("k8s-control-plane").alias("eventLocation"),
        pick(falco_stage, F.coalesce(_given(c("stage")), F.lit("audit-exec")), _given(c("stage"))).alias("stage"),
        result.alias("apiCallResult"),
        F.lit("1").alias("eventCount"),
        c("status_code").alias("statusCode"),
        shown_class.alias("classification"),
        c("severity").alias("severity"),
    )
    target = F.struct(
        pick(F.coalesce(_given(c("shown_pod")), container, rule), c("resource_name"), c("resource_name")).alias("objname"),
        pick(F.concat(F.lit("runtime/"), rule), F.lit("falco"), resource).alias("objtype"),
        F.when(kind == "falco", c("shown_namespace")).otherwise(c("namespace")).alias("objowner"),
        pick(falco_perm, exec_perm, c("derived_privileges")).alias("objperms"),
        result.alias("objaccessresult"),
        pick(_none(), invoked_by, asserted).alias("assertedroles"),
        pick(falco_perm, F.coalesce(c("command"), F.lit("exec-from-audit")),
             c("derived_privileges")).alias("assertedprivs"),
        pick(c("message"), F.coalesce(c("command"), c("message")), c("message")).alias("objchanges"),
        started.alias("objcreatetime"),
        c("completion_time").alias("objmodtime"),
        F.when((kind == "audit") & (verb == "delete"), c("completion_time")).alias("objdeletetime"),
    )
    kind_name = pick(
        F.concat(F.lit("falco."), slug(rule, "alert", "-")), F.lit("falco.exec-from-audit"),
        F.concat(F.lit("k8s.audit."), resource,
                 F.when(sub != "", F.concat(F.lit("."), sub)).otherwise(""), F.lit("."), verb))
    rows = with_all_pinned(rows, {"_type": F.concat(F.lit(type_prefix + "."), kind_name), "_source": source})
    rows = with_all_pinned(rows, {"_destination": destination})
    rows = with_all_pinned(rows, {"_network": network, "_object": target})
    return rows.select(
        F.lit("1.0").alias("specversion"), c("event_id").alias("id"), F.lit(source_urn).alias("source"),
        c("_type").alias("type"), c("timestamp").alias("time"),
        started.alias("invocationtime"), ended.alias("completetime"),
        F.lit("application/json").alias("dataContentType"), F.lit(data_schema).alias("dataSchema"),
        F.coalesce(_given(c("security_relevant")), F.lit("yes")).alias("securityRelevant"),
        F.struct(c("_source").alias("source"), c("_destination").alias("destination"),
                 c("_network").alias("network"), c("_object").alias("object")).alias("data"),
    )


def alert_streams(events: DataFrame) -> DataFrame:
    """Runtime rows as a log stream ``(labels, ts_ns, line)``, without the noisy classes."""
    quiet = events.where(~F.coalesce(F.col("classification").isin(*K.NOISY_CLASSES), F.lit(False)))
    rows = monitor_events(quiet).where(F.col("data.source.requestingService") == "falco")
    action = F.trim(F.coalesce(_given(F.col("data.source.requestMethod")), F.lit(K.DEFAULT_ACTION)))
    priority = action_priority(action, F.col("data.network.severity"))
    line = F.to_json(F.struct(
        iso_text(F.col("time")).alias("time"), action.alias("rule"), priority.alias("priority"),
        F.trim(F.coalesce(_given(F.col("data.source.requestUrl")), action)).alias("output"),
        F.lit("falco").alias("source"), F.lit("falco").alias("source_type"),
        F.col("id").alias("event_id"), F.col("data.network.classification").alias("classification"),
        _given(F.col("data.object.objowner")).alias("k8s.ns.name"),
        _given(F.col("data.object.objname")).alias("k8s.pod.name"),
    ))
    labels = F.create_map(
        F.lit("source"), F.lit("falco"), F.lit("source_type"), F.lit("falco"),
        F.lit("rule"), slug(action, "falco_alert"), F.lit("priority"), priority)
    return rows.select(labels.alias("labels"), epoch_ns(F.col("time")).alias("ts_ns"), line.alias("line"))


def audit_streams(events: DataFrame) -> DataFrame:
    """Audit rows as a log stream labelled by verb and resource."""
    rows = events.where(F.col("source_type") == "k8s_audit")
    labels = F.create_map(
        F.lit("source_type"), F.lit("k8s_audit"), F.lit("source"), F.lit("audit"),
        F.lit("verb"), F.coalesce("action", F.lit("unknown")),
        F.lit("resource"), F.coalesce("resource", F.lit("")))
    return rows.select(labels.alias("labels"), epoch_ns(F.col("timestamp")).alias("ts_ns"),
                       F.col("raw_event").alias("line"))
