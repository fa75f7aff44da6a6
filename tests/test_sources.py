import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from eventwarden.adapter import normalized, raw_items
from eventwarden.operators import policy as P
from eventwarden.sources import readers, versions, writers


def test_history_file(spark, tmp_path):
    path = tmp_path / "history.csv"
    path.write_text(
        "Timestamp (UTC),Invocation Time,Result,User / Subject,Method,Source IP,Namespace,Object Type,Object Name,_label\n"
        "2026-04-01 02:17:43+00:00,,Success,u,get,1.1.1.1,n,pods,p,normal\n"
        ",2026-04-01T02:17:44+00:00,unknown,u,get,1.1.1.1,n,pods,p,anomaly\n"
        "bad,,Success,u,get,1.1.1.1,n,pods,p,normal\n")
    rows = readers.read_history(spark, str(path)).orderBy("ts").collect()
    assert [(r.is_failed, r.label, r.event_type) for r in rows] == [(0, "normal", None), (1, "anomaly", None)]


def test_store_round_trip(spark, small, tmp_path):
    events = normalized(spark, small).select("event_id", "timestamp", "source_type", "message", "event_date",
                                             F.lit(1).alias("_private"))
    writers.append_event_store(events, str(tmp_path / "store"))
    (tmp_path / "store" / "event_date=2024-01-01" / "broken.json").write_text("{oops\n\n")
    back = readers.read_event_store(spark, str(tmp_path / "store"),
                                    "event_id string, timestamp timestamp, source_type string, message string, event_date date")
    assert back.count() == events.count()
    assert "_private" not in back.columns


def test_index_view_and_purge(spark, small, tmp_path):
    events = normalized(spark, small)
    path = str(tmp_path / "index")
    writers.append_table(events, path)
    writers.append_table(events.withColumn("ingest_ts", F.col("ingest_ts") + F.expr("INTERVAL 1 DAY")), path)
    view = writers.index_view(spark, path)
    assert view.count() == events.count()
    kept = P.within_retention(spark.read.parquet(path), 5, F.lit("2024-01-30").cast("timestamp"))
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in text
    assert P.within_retention(events, 0).count() == events.count()


def test_purge_rewrites_one_day_at_most(spark, small, tmp_path):
    path = str(tmp_path / "events")
    events = normalized(spark, small).select("event_id", "timestamp", "ingest_ts", "event_date")
    writers.append_table(events, path)
    days = sorted(p for p in (tmp_path / "events").iterdir() if p.is_dir())
    now = datetime(2024, 1, 15, 12, 30, tzinfo=timezone.utc)
    before = {p.name: sorted(f.name for f in p.iterdir()) for p in days}
    want = P.within_retention(spark.read.parquet(path), 5, F.lit("2024-01-15 12:30:00").cast("timestamp")).collect()
    done = writers.purge(spark, path, 5, now)
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "events").iterdir() if p.is_dir()}
    assert done == {"removed": sum(d < "event_date=2024-01-10" for d in before), "rewritten": 1} and done["removed"] > 3
    # Other days keep their files; only the day of the edge has new ones.
    assert [d for d in after if after[d] != before[d]] == ["event_date=2024-01-10"]
    assert sorted(spark.read.parquet(path).collect()) == sorted(want)
    assert writers.purge(spark, path, 5, now) == {"removed": 0, "rewritten": 0}
    assert writers.purge(spark, path, 0, now) == {"removed": 0, "rewritten": 0}


def test_compacted_versions(spark, tmp_path):
    """Random batches with repeats and equal times: what readers see stays the last version, in few files."""
    rng, folder, rows = random.Random(5), str(tmp_path / "index"), []
    assert versions.read_versions(spark, folder) is None
    assert versions.compact(spark, folder) == 0
    schema = "event_id string, ingest_ts timestamp, value int, tags map<string,string>"
    for batch in range(9):
        own = [(f"e{rng.randrange(40)}", datetime(2024, 1, 1, 0, rng.randrange(20), tzinfo=timezone.utc), rng.randrange(10 ** 6), {"a": "b"})
               for _ in range(30)]
        # An id comes once per batch, as equal times of one batch have no order.
        own = list({r[0]: r for r in own}.values())
        rows += [(*r, batch) for r in own]
        versions.append_versions(spark.createDataFrame(own, schema), folder, batch)
        if batch in (2, 3, 6):
            versions.append_versions(spark.createDataFrame(own, schema), folder, batch)
            assert versions.compact(spark, folder, buckets=4) == {2: 1, 3: 2, 6: 3}[batch]
        want = {}
        for r in sorted(rows, key=lambda r: (r[1], r[4])):
            want[r[0]] = r[2]
        found = versions.read_versions(spark, folder)
        assert "_batch" not in found.columns and {r.event_id: r.value for r in found.collect()} == want
    assert versions.compact(spark, folder, buckets=4) == 4 and versions.compact(spark, folder, buckets=4) == 4
    files = [p for p in (tmp_path / "index").rglob("*.parquet")]
    assert sum("version=4" in str(p) for p in files) <= 4
    # One older base, and the batches of the last compaction, stay for readers at work.
    assert {p.name for p in (tmp_path / "index" / "base").iterdir()} == {"version=3", "version=4"}
    assert {p.name for p in (tmp_path / "index" / "log").iterdir()} == {"batch_id=7", "batch_id=8"}


def test_topics_and_envelopes(spark, small):
    items = raw_items(spark, small)
    wrapped = writers.kafka_rows(items.where("source_type = 'k8s_audit'")).withColumn("topic", F.lit("k8s-audit-raw"))
    bare = items.where("source_type = 'falco'").select(F.col("body").alias("value"), F.lit("falco-alerts").alias("topic"))
    other = bare.withColumn("topic", F.lit("elsewhere"))
    found = readers.by_topic(wrapped.unionByName(bare).unionByName(other))
    assert {(r.source_type, r["count"]) for r in found.groupBy("source_type").count().collect()} == {
        ("k8s_audit", items.where("source_type = 'k8s_audit'").count()), ("falco", bare.count())}
    assert found.select("body").exceptAll(items.select("body")).count() == 0


def test_newest_and_latest(spark, small):
    events = normalized(spark, small)
    assert P.latest(events, 7).count() == 7
    assert P.latest(events, 0).count() == 0
    assert P.newest(events, 10).count() == 10


def test_rank_limits_run_before_the_shuffle(spark, small):
    plan = writers.last_version(normalized(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
