from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts as al
from tidewatch.plans import catalog
from tidewatch.sources.alert_store import AlertStore


@pytest.fixture(scope="module")
def alerts(spark, folder):
    return catalog.every_alert(spark, folder).cache()


@pytest.fixture
def store(spark, alerts, tmp_path):
    made = AlertStore(spark, str(tmp_path / "store"), buckets=4)
    made.upsert(alerts)
    return made


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_an_empty_store(spark, tmp_path):
    empty = AlertStore(spark, str(tmp_path / "none"))
    assert empty.read().count() == 0 and empty.alert("x").count() == 0 and empty.manifest() == {}
    empty.merge()
    assert empty.vacuum() == 0


def test_alerts_come_back_whole(alerts, store):
    text = lambda df: df.select(F.to_json(F.struct(*sorted(alerts.columns))).alias("row"))
    for _ in range(2):
        assert store.read().count() == alerts.count() and text(store.read()).exceptAll(text(alerts)).isEmpty()
        store.merge()
    assert ids(store.read("network")) == ids(alerts.where("modality = 'network'"))
    with pytest.raises(ValueError):
        store.read("other")


def test_the_last_write_counts(alerts, store):
    one = alerts.orderBy("id").limit(1).collect()[0]["id"]
    mine = alerts.where(F.col("id") == one)
    newer = mine.withColumns({"timestamp": F.col("timestamp") + F.expr("INTERVAL 40 DAYS"), "source": F.lit("newer")})
    older = mine.withColumns({"timestamp": F.col("timestamp") - F.expr("INTERVAL 40 DAYS"), "source": F.lit("older")})
    for change in (newer, older):
        store.upsert(change)
        assert [r["source"] for r in store.alert(one).collect()] == ["newer"]
    store.upsert(newer.withColumn("source", F.lit("same time, later write")))
    store.merge()
    assert [r["source"] for r in store.alert(one).collect()] == ["same time, later write"]
    assert store.read().count() == alerts.count()


def test_merging_rewrites_only_cells_that_changed(alerts, store):
    store.merge()
    before = store.manifest()["base"]
    one = alerts.orderBy("id").limit(1)
    store.upsert(one.withColumn("source", F.lit("again")))
    store.merge()
    after = store.manifest()
    assert sum(before[c] != after["base"][c] for c in before) == 1 and after["updates"] == []
    assert store.vacuum(keep=1) == 0 and store.vacuum(keep=1, grace_seconds=0) == 2  # both segments of updates
    assert store.read().count() == alerts.count() and len(store.versions()) == 1


def test_updates_are_merged_by_themselves(spark, alerts, tmp_path):
    small = AlertStore(spark, str(tmp_path / "s"), buckets=2, merge_after=2)
    for part in range(3):
        small.upsert(alerts.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part))
    assert len(small.manifest()["updates"]) == 1 and ids(small.read()) == ids(alerts)
    assert AlertStore(spark, small.path, buckets=99).buckets == 2  # the store knows its buckets


def test_a_batch_is_applied_once(alerts, store):
    changed = alerts.withColumn("source", F.lit("batch"))
    store.upsert(changed, "feed", 3)
    version = store.manifest()["version"]
    store.upsert(alerts, "feed", 3)
    store.upsert(alerts, "feed", 2)
    assert store.manifest()["version"] == version and store.read().where("source = 'batch'").count() == alerts.count()


def test_two_writers(spark, alerts, store):
    other = AlertStore(spark, store.path)
    first = store.manifest()
    assert store._publish(first | {"version": first["version"] + 1})
    assert not other._publish(first | {"version": first["version"] + 1, "updates": []})
    other.upsert(alerts.limit(1).withColumn("source", F.lit("other")))
    assert store.manifest()["version"] == first["version"] + 2 and store.read().where("source = 'other'").count() == 1
    assert store.read(version=first["version"]).where("source = 'other'").count() == 0


def test_filters_reach_the_files(store):
    store.merge()
    plan = store.read("network")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "modality" in plan.split("PartitionFilters")[1][:200] and "Exchange" not in plan
    one = store.read().orderBy("id").limit(1).collect()[0]["id"]
    store.upsert(store.read("metric").limit(1))
    plan = store.alert(one)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") >= 1  # also below the search for the last write


def test_alerts_since_a_day(alerts, store):
    for _ in range(2):
        found = store.read("network", since="1996-01-01")
        assert ids(found) == ids(alerts.where("modality = 'network' and timestamp >= '1996-01-01'")) != []
        store.merge()
    plan = store.read("network", since="1996-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,1996-01-01)" in plan  # skips files and row groups


def test_acknowledgements_are_kept(spark, alerts, store):
    some = alerts.select(F.col("id").alias("alert_id")).limit(5)
    want = ids(some.withColumnRenamed("alert_id", "id"))
    store.acknowledge(some.unionByName(spark.createDataFrame([("nobody",)], "alert_id string")))
    assert ids(store.read().where("is_acknowledged")) == want and store.read().count() == alerts.count()
    assert ids(al.get_alert(store.alert(want[0]), want[0])) == [want[0]]
