"""State per user and address: equal to the batch job, bounded, and going on after a restart."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventwarden.adapter import scorer_events
from eventwarden.constants import DAY_US, FEATURE_COLS, HOUR_US, MINUTE_US
from eventwarden.models.sequence import sequence_windows
from eventwarden.operators.rolling import IP_PLAN, USER_PLAN
from eventwarden.plans.features import feature_matrix
from eventwarden.streaming import online
from eventwarden.streaming import scores as SC


@pytest.mark.parametrize("plan", [USER_PLAN, IP_PLAN], ids=["user", "ip"])
def test_key_history_equals_brute_force(plan):
    rng = random.Random(3)
    start = 19_700 * DAY_US
    flags = sorted({s.value for s in plan.sums if s.value})
    events = []
    for n in range(260):
        us = start + rng.randrange(40) * DAY_US + rng.randrange(24) * HOUR_US + rng.choice([0, 0, 1, MINUTE_US, 5 * MINUTE_US, HOUR_US - 1])
        events.append({"us": us, **{f: rng.randrange(2) for f in flags}, **{d.column: rng.choice("abc") for d in plan.distincts}})
    events.sort(key=lambda e: e["us"])
    history = online.KeyHistory(plan, {}, lambda hour: ((), ()), {})
    for low in range(0, len(events), 37):
        batch = events[low:low + 37]
        us = np.array([e["us"] for e in batch])
        history.add(us, sum(np.array([e[f] for e in batch]) << k for k, f in enumerate(flags)),
                    {d.name: [e[d.column] for e in batch] for d in plan.distincts})
        found = history.measures(us)
        for n, e in enumerate(batch):
            def past(width, now=e["us"]):
                return [h for h in events if now - width <= h["us"] < now]
            for s in plan.sums:
                assert found[s.name][n] == sum(h[s.value] if s.value else 1 for h in past(s.width_us)), s.name
            for d in plan.distincts:
                assert found[d.name][n] == len({h[d.column] for h in past(d.width_us)}), d.name
            for x in plan.hours:
                hour = e["us"] // HOUR_US % 24
                assert found[x.name][n] == sum(h["us"] // HOUR_US % 24 == hour for h in past(x.width_us))


def _in_order(spark, small, path, parts=3):
    """The events as files in order of time, as a live stream would bring them, and a row that has no time."""
    events = scorer_events(spark, small).select(*SC.HISTORY_COLUMNS)
    edges = events.selectExpr(f"percentile(unix_micros(ts), array({', '.join(str(k / parts) for k in range(1, parts))})) AS p").first()["p"]
    for n in range(parts):
        low, high = ([None, *edges][n], [*edges, None][n])
        part = events
        part = part if low is None else part.where(F.unix_micros("ts") >= low)
        part = part if high is None else part.where(F.unix_micros("ts") < high)
        part.coalesce(1).write.mode("append").parquet(path)
    return events


def _collect(spark, stream, out, checkpoint):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination(600)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return query


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, small, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    events = _in_order(spark, small, source)

    def stream():
        rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        return SC.online_rows(rows).select("event_id", "user", *FEATURE_COLS, "window", "seq_active")

    _collect(spark, stream(), out, checkpoint)
    last = events.agg(F.max("ts")).first()[0]
    # Later events of known users, and one without a time, come after a restart.
    later = events.limit(40).withColumns({"event_id": F.col("event_id") + 10 ** 6, "ts": F.lit(last) + F.expr("INTERVAL 1 HOUR")})
    later.unionByName(later.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))).coalesce(1).write.mode("append").parquet(source)
    _collect(spark, stream(), out, checkpoint)
    whole = sequence_windows(feature_matrix(scorer_events_of(events.unionByName(later))))
    columns = ["event_id", *FEATURE_COLS, "window", "seq_active"]
    found = spark.read.parquet(out)
    assert found.where("user IS NULL OR feat_hour IS NULL").count() == 1
    rows = found.where("feat_hour IS NOT NULL").select(columns)
    assert rows.count() == whole.count() == events.count() + 40
    assert rows.exceptAll(whole.select(columns)).count() == 0


def scorer_events_of(events):
    from eventwarden.plans.features import with_event_flags

    return with_event_flags(events)


def test_state_older_than_its_time_is_gone(spark, tmp_path):
    """One file per day; user v comes on the first day only, and not again."""
    source, schema = str(tmp_path / "in"), "user string, us bigint, is_failed int, is_sensitive int, namespace string, object_type string, source_ip string"
    days = [0, 1, 2, 40, 41]
    for n, day in enumerate(days):
        us = (19_700 + day) * DAY_US
        rows = [("u", us, 0, 0, f"n{n}", "o", "i")] + [("v", us, 0, 0, f"n{k}", "o", "i") for k in range(9) if day == 0]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    clocked = online.with_clock(stream, F.timestamp_micros("us"))
    query = _collect(spark, online.with_online_history(clocked, USER_PLAN), str(tmp_path / "out"), str(tmp_path / "cp"))
    sizes = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    rows = {r.us // DAY_US - 19_700: r for r in spark.read.parquet(str(tmp_path / "out")).where("user = 'u'").collect()}
    assert [rows[d].req_30d for d in days] == [0, 1, 2, 0, 1]
    assert rows[2].unique_namespaces == 2 and rows[41].unique_namespaces == 1
    # What is left is u's last days; v and all that is older are gone.
    assert sizes[-1] < sizes[0] and sizes[-1] < sizes[2]
