import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventwarden.adapter import raw_items, scorer_events, security_rows
from eventwarden.constants import HOUR_US
from eventwarden.functions.rules import falco_classification
from eventwarden.operators.dedup import throttle
from eventwarden.operators.normalize import open_envelope
from eventwarden.plans.features import feature_matrix
from eventwarden.plans.ingest import ingest, ingest_report, outcomes
from eventwarden.sources.readers import stream_lines
from eventwarden.sources.writers import kafka_rows
from eventwarden.streaming import events as E
from eventwarden.streaming import scores as SC


def test_ingest_stream_equals_batch(spark, small, tmp_path):
    lines = kafka_rows(raw_items(spark, small))
    lines.union(spark.createDataFrame([("{broken",), ('{"source_type":"app","event":{"x":1}}',)], "value string")) \
        .write.text(str(tmp_path / "in"))
    stream = stream_lines(spark, str(tmp_path / "in"), 1)
    query = E.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    query.awaitTermination(300)
    batch = ingest(open_envelope(spark.read.text(str(tmp_path / "in"))))
    columns = ["event_id", "classification", "tags", "severity"]
    done = spark.read.parquet(str(tmp_path / "out")).select(columns)
    assert done.count() > 0
    assert done.exceptAll(batch.select(columns)).count() == 0
    assert batch.select(columns).exceptAll(done).count() == 0
    bad = {r.problem for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert bad == {"unreadable", "message missing"}


def test_ingest_stream_stores_a_replay_once_and_late_events_apart(spark, small, tmp_path):
    items = raw_items(spark, small)
    late = F.col("event_no") % 3 == 0
    rows = items.select(
        F.concat(F.lit('{"source_type":"'), "source_type", F.lit('","source":"audit","event":'), "body", F.lit("}")).alias("value"),
        F.when(late, F.col("ingest_ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ingest_ts")).alias("ingest_ts"))
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = E.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp"),
                           late_table=str(tmp_path / "late"), remember="60 days")
    query.awaitTermination(300)
    want = ingest(open_envelope(rows)).dropDuplicates(["event_id", "stage"])
    edge = F.col("timestamp") < F.col("ingest_ts") - F.expr("INTERVAL 10 MINUTES")
    for name, part in (("out", want.where(~edge)), ("late", want.where(edge))):
        found = spark.read.parquet(str(tmp_path / name))
        assert found.count() == part.count() > 100
        assert found.select("event_id").exceptAll(part.select("event_id")).count() == 0
        # Laid out by day, then batch.
        assert all(p.name.startswith(("event_date=", "_", ".")) for p in (tmp_path / name).iterdir())


def _alert_files(spark, small, path, parts=4):
    rows = security_rows(spark, small).where("source_type = 'falco'").select(
        "event_id", F.unix_micros("ts").alias("us"), F.col("ts").alias("timestamp"),
        falco_classification(F.col("rule")).alias("classification"))
    rows = rows.where(F.col("classification").startswith("falco_contact"))
    ordered = rows.orderBy("us").collect()
    size = -(-len(ordered) // parts)
    for i in range(parts):
        spark.createDataFrame(ordered[i * size:(i + 1) * size], rows.schema).coalesce(1) \
            .write.mode("append").parquet(path)
    return rows


@pytest.mark.parametrize("live", [False, True])
def test_throttle_stream_equals_batch(spark, small, tmp_path, live):
    rows = _alert_files(spark, small, str(tmp_path / "in"))
    gap = 12 * HOUR_US
    stream = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
              .parquet(str(tmp_path / "in")))
    if live:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        query = (E.throttle_live(stream, gap_us=gap).writeStream.outputMode("append")
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
                 .format("parquet").option("path", str(tmp_path / "out")).start())
    else:
        query = E.start_throttle(stream, str(tmp_path / "out"), str(tmp_path / "cp"), gap_us=gap)
    query.awaitTermination(300)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    ours = {r.us for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    theirs = {r.us for r in throttle(rows, gap_us=gap).collect()}
    assert ours == theirs and len(ours) > 3


def test_dedup_windows_and_sessions(spark, small, tmp_path):
    rows = security_rows(spark, small).select(
        F.col("event_id"), F.col("ts").alias("timestamp"), F.col("user_name"), F.col("verb"),
        F.lit("ResponseComplete").alias("stage"))
    rows.union(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    # A last row far ahead closes all windows.
    spark.createDataFrame([(10 ** 9, "end", "none", "x")], "event_id bigint, user_name string, verb string, stage string") \
        .withColumn("timestamp", F.lit("2030-01-01").cast("timestamp")).select(*rows.columns) \
        .write.mode("append").parquet(str(tmp_path / "in"))
    stream = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 10)
              .parquet(str(tmp_path / "in")))

    def run(name, df):
        query = (df.writeStream.outputMode("append").format("memory").queryName(name)
                 .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
        query.awaitTermination(300)
        return spark.table(name)

    assert run("unique_events", E.dedup_stream(stream, delay="60 days")).count() == rows.count() + 1
    counts = run("verb_counts", E.counts_over_time(stream, "verb", width="1 day"))
    assert counts.agg(F.sum("events")).first()[0] == 2 * rows.count()
    sessions = run("user_runs", E.bursts(stream, gap="6 hours"))
    assert sessions.agg(F.sum("events")).first()[0] == 2 * rows.count()


def test_late_rows(spark):
    rows = spark.sql("SELECT 1 AS event_id, timestamp'2024-01-01 10:00:00' AS timestamp, timestamp'2024-01-01 10:05:00' AS ingest_ts "
                     "UNION ALL SELECT 2, timestamp'2024-01-01 09:00:00', timestamp'2024-01-01 10:05:00'")
    fine, late = E.split_late(rows)
    assert [r.event_id for r in fine.collect()] == [1]
    assert [r.event_id for r in late.collect()] == [2]


def test_scoring_stream(spark, small, tmp_path):
    from eventwarden.plans.scoring import train_forest, train_sequence
    from eventwarden.session import cut_lineage

    matrix = cut_lineage(feature_matrix(scorer_events(spark, small)))
    models = str(tmp_path / "models")
    train_forest(matrix, models, trees=20)
    labels = matrix.select("user", "ts", F.when(F.col("is_failed") == 1, "anomaly").otherwise("normal").alias("label"),
                           F.col("event_id").alias("seq"))
    train_sequence(matrix, labels, models, kind="linear", iterations=5)
    items = raw_items(spark, small).where("source_type <> 'app'")
    messages = items.select(
        F.when(F.col("source_type") == "falco", "falco-alerts").otherwise("k8s-audit-raw").alias("topic"),
        F.col("body").alias("value"), F.col("event_no").alias("event_id"))
    half = messages.where("event_id < 500")
    for rows in (half, messages.where("event_id >= 500")):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = SC.start_scoring(stream, str(tmp_path / "out"), models, str(tmp_path / "cp"))
    query.awaitTermination(600)
    scored = spark.read.parquet(str(tmp_path / "out" / "scored"))
    assert scored.count() == messages.count()
    # Windows reach back over batches: the 20th event of a user and all later ones are full.
    order = Window.partitionBy("user").orderBy("us", "event_id")
    full = scored.withColumn("place", F.row_number().over(order))
    assert full.where("(place >= 20) <> seq_active").count() == 0
    assert scored.where("seq_active AND seq_score IS NOT NULL").count() > 0
    assert scored.where("risk_level IS NULL OR reason = ''").count() == 0
    assert scored.select("batch_id").distinct().count() == 2
    # What travels beside the state comes back whole, and no history is kept in tables.
    bodies = scored.select("event_id", "body").exceptAll(messages.select("event_id", F.col("value").alias("body")))
    assert bodies.count() == 0
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"alerts", "scored", "unreadable"}


def test_batch_reports_add_up(spark, small, tmp_path):
    items = raw_items(spark, small)
    rows = items.select(
        F.concat(F.lit('{"source_type":"'), "source_type", F.lit('","source":"audit","event":'), "body", F.lit("}")).alias("value"),
        "ingest_ts")
    broken = spark.createDataFrame([("{broken",), ('{"source_type":"app","event":{"x":1}}',)], "value string").withColumn(
        "ingest_ts", F.lit("2024-01-10 00:00:00").cast("timestamp"))
    for part in (rows.where("hash(value) % 2 = 0"), rows.where("hash(value) % 2 <> 0").unionByName(broken), rows.limit(50)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / n) for n in ("out", "bad", "cp")]
    E.start_ingest(stream, *paths, remember="60 days", report_table=str(tmp_path / "reports")).awaitTermination(300)
    reports = spark.read.parquet(str(tmp_path / "reports"))
    counts = ["accepted", "stored", "dropped", "failed"]
    added = {(r["dimension"], r["value"]): tuple(r[c] for c in counts) for r in reports.groupBy("dimension", "value").agg(
        *[F.sum(c).alias(c) for c in counts]).collect()}
    # Repeated rows count once, as in the stored table.
    whole = ingest_report(outcomes(open_envelope(rows.unionByName(broken))))
    want = {(r["dimension"], r["value"]): tuple(r[c] for c in counts) for r in whole.collect()}
    assert added == want
    total = added["total", "all"]
    assert total[3] == 2 and total[1] > 0 and total[2] > 0 and sum(total[1:]) == total[0]
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == total[1] and stored.where("tags IS NULL").count() == 0
    for row in reports.where("dimension = 'total'").collect():
        assert len(row["ids"]) <= 10
        assert stored.where((F.col("batch_id") == row["batch_id"]) & F.col("event_id").isin(row["ids"])).count() == len(row["ids"])
