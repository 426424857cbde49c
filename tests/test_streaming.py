"""Files and streams: the stream must give what the batch gives."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import sql
from tidewatch.operators import alerts as al
from tidewatch.operators import features as fe
from tidewatch.plans import catalog
from tidewatch.schemas import FLOW_SCHEMA, LOG_SCHEMA
from tidewatch.sources import files, views
from tidewatch.sources.alert_store import AlertStore
from tidewatch.streaming import pipeline as st


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "logs.jsonl"
    path.write_text(
        '{"timestamp": "2024-01-01T10:00:00", "log_type": "auth", "message": "Invalid user", "is_anomaly": true, "source": "h1"}\n'
        "\n"
        "not json\n"
    )
    rows = files.read_jsonl(spark, str(path), LOG_SCHEMA, "bad").collect()
    good = [r for r in rows if r["bad"] is None]
    assert len(good) == 1 and good[0]["timestamp"] == dt.datetime(2024, 1, 1, 10) and good[0]["anomaly_type"] is None
    assert [r["bad"] for r in rows if r["bad"]] == ["not json"]
    clean = files.read_jsonl(spark, str(path), LOG_SCHEMA).where("source is not null")
    files.write_jsonl(clean, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), LOG_SCHEMA).collect() == clean.collect()


def test_csv_round_trip(spark, folder, tmp_path):
    flows = views.flows(spark, folder).withColumn("service", F.lit("X")).withColumnRenamed("ts", "timestamp")
    part = flows.select(*FLOW_SCHEMA.fieldNames())
    files.write_csv(part, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), FLOW_SCHEMA)
    assert back.exceptAll(part).count() == 0 and back.count() == part.count()


def test_alert_store(spark, folder, tmp_path):
    alerts = catalog.metric_alerts(spark, folder)
    files.write_alerts(alerts, str(tmp_path / "store"))
    stored = files.read_alerts(spark, str(tmp_path / "store"))
    assert stored.count() == alerts.count() and set(stored.columns) == set(alerts.columns)
    one = stored.first()
    assert al.get_alert(stored, one["id"]).count() == 1
    text = stored.where("modality = 'metric'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(modality" in text


@pytest.fixture(scope="module")
def feed(spark, folder, tmp_path_factory):
    """Flows as several JSON files."""
    path = tmp_path_factory.mktemp("feed") / "flows"
    rows = views.flows(spark, folder)
    rows.repartition(4).write.json(str(path))
    return str(path), rows.schema


def test_stream_equals_batch(spark, folder, feed, tmp_path):
    path, schema = feed
    rows, plan = catalog.flow_pipeline(spark, folder)
    stream = st.score_stream(st.stream_jsonl(spark, path, schema, files_per_batch=2), plan.alerts)
    running = st.write_alert_stream(stream, str(tmp_path / "alerts"), str(tmp_path / "check"), available_now=True)
    running.awaitTermination(120)
    got = files.read_alerts(spark, str(tmp_path / "alerts")).select("id", "fused_score", "severity", "narrative")
    want = plan.alerts(rows).select("id", "fused_score", "severity", "narrative")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_restart_adds_nothing(spark, folder, feed, tmp_path):
    path, schema = feed
    _, plan = catalog.flow_pipeline(spark, folder)
    for _ in range(2):
        stream = st.score_stream(st.stream_jsonl(spark, path, schema), plan.alerts)
        st.write_alert_batches(stream, str(tmp_path / "a"), str(tmp_path / "c"), available_now=True).awaitTermination(120)
    stored = AlertStore(spark, str(tmp_path / "a")).read()
    assert stored.count() == stored.select("id").distinct().count() > 0


def test_score_stream_wants_a_stream(spark):
    with pytest.raises(ValueError):
        st.score_stream(spark.range(1), lambda df: df)


def write_events(spark, path, rows):
    df = spark.createDataFrame(rows, "id string, ts string, modality string, is_alert boolean")
    df.coalesce(1).write.mode("append").json(path)


EVENTS = "id string, ts timestamp, modality string, is_alert boolean"


def run_files(spark, build, batches, tmp_path, mode):
    """Feed batches one after another through the same query and return all rows it wrote."""
    feed, check, seen = str(tmp_path / "in"), str(tmp_path / "ck"), []

    def keep(batch, _):
        seen.extend(batch.collect())

    for rows in batches:
        write_events(spark, feed, rows)
        stream = build(st.stream_jsonl(spark, feed, spark.createDataFrame([], EVENTS).schema))
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", check).foreachBatch(keep)
        query.trigger(availableNow=True).start().awaitTermination(120)
    return seen


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    batches = [
        [("1", "2024-01-01T10:05:00", "log", True), ("2", "2024-01-01T10:50:00", "log", False)],
        [("3", "2024-01-01T13:00:00", "log", False)],   # moves the watermark past the first window
        [("4", "2024-01-01T10:10:00", "log", True)],    # too late
        [("5", "2024-01-01T16:00:00", "log", False)],
    ]
    seen = run_files(spark, lambda s: al.windowed_stats(s, "1 hour", late="30 minutes"), batches, tmp_path, "append")
    first = [r for r in seen if r["window_start"] == dt.datetime(2024, 1, 1, 10)]
    assert [(r["n"], r["anomalies"], r["anomaly_rate"]) for r in first] == [(2, 1, 0.5)]


def test_the_last_write_of_a_stream(spark, tmp_path):
    batches = [
        [("a", "2024-01-01T10:00:00", "log", True), ("a", "2024-01-01T10:01:00.000500", "log", False), ("c", "2024-01-01T10:00:00", "log", True)],
        [("a", "2024-01-01T10:02:00", "metric", True), ("b", "2024-01-01T10:02:00", "log", None)],
        [("a", "2024-01-01T10:01:30", "log", False)],                                                 # older than what is known
        [("d", "2024-01-01T13:00:00", "log", True)],                                                  # all before are settled
        [("e", "2024-01-01T17:00:00", "log", True)],
    ]
    seen = run_files(spark, lambda s: st.last_write_stream(s, "30 minutes", "10 minutes", "ts"), batches, tmp_path, "append")
    got = sorted((r["id"], r["ts"].isoformat(), r["modality"], r["is_alert"]) for r in seen)
    assert got == [
        ("a", "2024-01-01T10:02:00", "metric", True), ("b", "2024-01-01T10:02:00", "log", None),
        ("c", "2024-01-01T10:00:00", "log", True), ("d", "2024-01-01T13:00:00", "log", True),
    ]


def test_batch_and_stream_agree_on_a_replay_with_updates(spark, folder, tmp_path):
    alerts = catalog.metric_alerts(spark, folder).cache()
    again = alerts.where(F.conv(F.substring("id", 1, 1), 16, 10).cast("int") % 3 == 0).withColumns(
        {"timestamp": F.col("timestamp") + F.expr("INTERVAL 1 DAY"), "severity": F.lit("low")})
    every = alerts.unionByName(again).withColumn("_part", F.pmod(F.xxhash64("id", "timestamp"), F.lit(3))).cache()
    feed = str(tmp_path / "in")
    store = AlertStore(spark, str(tmp_path / "store"), merge_after=3)
    for part in range(3):  # updates come in any order, also before what they replace
        every.where(F.col("_part") == part).drop("_part").coalesce(2).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(alerts.schema).parquet(feed)
        st.write_alert_batches(stream, store.path, str(tmp_path / "ck"), available_now=True).awaitTermination(120)
    want = al.dedupe_alerts(every.drop("_part"))
    text = lambda df: df.select("id", "timestamp", "severity", F.to_json(F.struct(*sorted(alerts.columns))).alias("row"))
    got = text(store.read())
    assert got.count() == want.count() > again.count() > 0 and got.exceptAll(text(want)).isEmpty()


def test_batch_dedupe_keeps_the_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")], "id string, timestamp int, v string")
    assert {(r["id"], r["v"]) for r in al.dedupe_alerts(df).collect()} == {("a", "z"), ("b", "w")}


def test_sql_functions_cover_the_network_features(spark, folder):
    assert "severity_rank" in sql.register(spark)
    assert spark.sql("SELECT fuse_threshold_ratio(1, 1, 1, 1), severity_rank('high'), bounds_normalized(5, 0, 1)").first()[:] == (0.5, 3, 1.0)
    views.flows(spark, folder).createOrReplaceTempView("tw_flows")
    got = spark.sql("SELECT flow_id, byte_asymmetry(bytes_out, bytes_in) AS v FROM tw_flows")
    want = fe.add_network_features(views.flows(spark, folder)).select("flow_id", F.col("byte_asymmetry").alias("v"))
    assert got.exceptAll(want).count() == 0
