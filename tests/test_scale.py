"""Order-dependent operators against brute force: hot values, ties, and other layouts of the same rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluate as ev
from tidewatch.operators import ordering
from tidewatch.operators.sampling import stratified_split


@pytest.fixture(scope="module")
def skewed():
    """Scores where one value holds a third of the rows."""
    rng = np.random.default_rng(3)
    s = np.round(rng.exponential(size=6000), 3)
    s[rng.random(6000) < 0.34] = 0.5
    y = (rng.random(6000) < np.clip(s / 4, 0.02, 0.9)).astype(int)
    return s, y


def table(spark, s, y, parts=None):
    rows = [(int(i), float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))]
    df = spark.createDataFrame(rows, "k long, s double, y int")
    return df.repartition(parts) if parts else df


def brute_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("parts", [None, 1, 17])
def test_auc_and_ap(spark, skewed, parts):
    s, y = skewed
    row = ev.ranking_metrics(table(spark, s, y, parts), "s", "y").first()
    assert row["roc_auc"] == pytest.approx(brute_auc(s, y), abs=1e-12)
    total, ap = y.sum(), 0.0
    for t in np.unique(s):
        hit = s >= t
        ap += y[s == t].sum() / total * y[hit].sum() / hit.sum()
    assert row["avg_precision"] == pytest.approx(ap, abs=1e-12)


def test_auc_ignores_monotone_maps(spark, skewed):
    s, y = skewed
    df = table(spark, s, y).withColumn("t", F.exp(F.col("s") / 3) * 2 + 1)
    got = ev.ranking_metrics(df, "s", "y").first()["roc_auc"], ev.ranking_metrics(df, "t", "y").first()["roc_auc"]
    assert got[0] == pytest.approx(got[1], abs=1e-12)


def test_recall_never_rises_with_the_threshold(spark, skewed):
    s, y = skewed
    points = [r for r in ev.pr_curve(table(spark, s, y), "s", "y").collect() if r["threshold"] is not None]
    recalls = [r["recall"] for r in sorted(points, key=lambda r: r["threshold"])]
    assert recalls == sorted(recalls, reverse=True) and len(points) == len(np.unique(s))


@pytest.mark.parametrize("buckets", [2, 8, 64])
def test_row_index_with_a_hot_value(spark, skewed, buckets):
    s, y = skewed
    got = ordering.row_index(table(spark, s, y, 5), ["s", "k"], buckets=buckets).select("k", "row_index").collect()
    order = np.lexsort((np.arange(len(s)), s))
    want = np.empty(len(s), dtype=int)
    want[order] = np.arange(len(s))
    assert all(want[r["k"]] == r["row_index"] for r in got) and len(got) == len(s)


def range_sizes(df, order_by, by, buckets):
    """Rows per range of the table that the running totals write."""
    seen = []
    real = ordering.durable

    def spy(table):
        out = real(table)
        if "_run_c" in table.columns:
            seen.append(out)
        return out

    ordering.durable = spy
    try:
        ordering.running_totals(df, {"c": F.lit(1)}, order_by, by, buckets)
    finally:
        ordering.durable = real
    return [r["count"] for r in seen[0].groupBy("_range").count().collect()]


@pytest.mark.parametrize("order_by", [["s", "k"], ["s"]])
def test_a_hot_value_is_split_over_ranges(spark, skewed, order_by):
    s, y = skewed
    sizes = range_sizes(table(spark, s, y), order_by, [], 32)  # also where nothing breaks the tie
    assert len(sizes) > 20 and max(sizes) < 4 * len(s) / 32


@pytest.mark.parametrize("buckets", [None, 200])
def test_row_index_over_a_year_of_days(spark, buckets):
    n = 40_000
    days = spark.range(n).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(365))).alias("day")).repartition(5)
    rows = days.select(F.col("k"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("day").cast("int")).alias("ts"))
    want = {r["k"]: i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (r["ts"], r["k"])))}
    got = ordering.row_index(rows, ["ts", "k"], buckets=buckets).collect()
    assert len(got) == n and all(want[r["k"]] == r["row_index"] for r in got)


def test_row_index_by_text_and_of_wide_rows(spark):
    rows = spark.range(3000).select(
        F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(700)).cast("string")).alias("name"), "id", F.array("id").alias("list"),
        F.create_map(F.lit("a"), F.col("id")).alias("map"), F.struct("id").alias("row"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("hole"))
    got = ordering.row_index(rows, ["name", "id"], buckets=9, total=True).collect()
    want = {k: i for i, k in enumerate(sorted((r["name"], r["id"]) for r in got))}
    assert len(got) == 3000 and all(want[r["name"], r["id"]] == r["row_index"] and r["list"] == [r["id"]] and r["row"]["id"] == r["id"] for r in got)
    assert {r["row_index_total"] for r in got} == {3000}


def test_running_totals_of_nothing_and_of_floats(spark):
    none = spark.createDataFrame([], "s double, y double")
    assert ordering.running_totals(none, {"cum": F.col("y")}, ["s"], totals=True).count() == 0
    rows = spark.createDataFrame([(i % 5, float(i), None if i == 3 else 0.5) for i in range(50)], "g long, s double, y double")
    got = ordering.running_totals(rows, {"cum": F.col("y"), "n": F.lit(1)}, ["s"], ["g"], 7).collect()
    assert all(r["cum"] == 0.5 * (r["n"] - (r["g"] == 3)) and r["n"] == r["s"] // 5 + 1 for r in got) and len(got) == 50


def test_no_range_stands_in_a_plan(spark, skewed):
    """Neither cut points nor samples: the plan of a large number of ranges is as long as that of a few."""
    s, y = skewed
    lengths = [len(ordering.row_index(table(spark, s, y), ["s", "k"], buckets=n)._jdf.queryExecution().optimizedPlan().toString()) for n in (4, 400)]
    assert abs(lengths[0] - lengths[1]) < 100


def test_running_totals_keep_null_groups(spark):
    rows = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 2), ("a", 1.0, 5), ("a", None, 7)], "g string, s double, y int")
    got = ordering.running_totals(rows, {"cum": F.col("y")}, ["s"], ["g"], 4, totals=True).collect()
    assert sorted((str(r["g"]), r["s"] or 0.0, r["cum"], r["cum_total"]) for r in got) == [
        ("None", 1.0, 1, 3), ("None", 2.0, 3, 3), ("a", 0.0, 7, 12), ("a", 1.0, 12, 12)]


def test_a_measured_text_is_not_shuffled(spark, folder):
    from tidewatch.plans import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lengths = catalog.message_lengths(spark, folder)
        rows, _ = catalog.log_model(spark, folder)
        for df in (lengths, rows.select("log_id", "message_length", "is_anomaly")):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            above = plan.split("Join")[0] if "Join" in plan else ""
            assert "length(" not in above and "message#" not in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_orphans_and_last_writes(spark):
    from tidewatch.operators import alerts as al

    alerts = spark.createDataFrame([("a", 1, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 2, "q")], "id string, timestamp int, v string")
    for parts in (1, 3):
        assert {r["id"]: r["v"] for r in al.dedupe_alerts(alerts.repartition(parts)).collect()} == {"a": "z", "b": "q"}
    acks = spark.createDataFrame([("a", 1), ("c", 2), ("c", 3), ("c", 3), (None, 4)], "alert_id string, n int")
    assert sorted(r["n"] for r in al.acks_without_alert(alerts, acks).collect()) == [2, 3, 3, 4]


def test_running_totals_per_group(spark, skewed):
    s, y = skewed
    df = table(spark, s, y).withColumn("g", F.col("k") % 3)
    got = ordering.running_totals(df, {"cum": F.col("y")}, ["s", "k"], ["g"], 16, totals=True).collect()
    for g in range(3):
        keys = np.arange(len(s))[np.arange(len(s)) % 3 == g]
        order = keys[np.lexsort((keys, s[keys]))]
        want = dict(zip(order.tolist(), np.cumsum(y[order]).tolist()))
        mine = {r["k"]: r["cum"] for r in got if r["g"] == g}
        assert mine == want
        assert {r["cum_total"] for r in got if r["g"] == g} == {int(y[keys].sum())}


def test_exact_quantiles(spark, skewed):
    s, y = skewed
    fractions = [0.0, 0.25, 0.5, 0.92, 0.99, 1.0]
    df = table(spark, s, y, 9)
    got = ordering.exact_quantiles(df, "s", fractions)[()]
    assert [got[f] for f in fractions] == pytest.approx(np.quantile(s, fractions).tolist(), abs=1e-12)
    few = ordering.exact_quantiles(df, "s", fractions, most=300, sketch=64, margin=0.05)[()]
    wrong = ordering.exact_quantiles(df, "s", fractions, most=300, sketch=8, margin=0.0001)[()]  # ranges that miss their rank
    assert few == got and wrong == got
    by = ordering.exact_quantiles(df, "s", fractions, ["y"], most=200, sketch=64, margin=0.05)
    for label in (0, 1):
        assert [by[(label,)][f] for f in fractions] == pytest.approx(np.quantile(s[y == label], fractions).tolist(), abs=1e-12)
    assert ordering.exact_quantile(df.where("s < 0"), "s", 0.5) is None
    assert ordering.exact_quantile(df.where("k = 3"), "s", 0.5) == s[3]


def test_nulls_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 1), (0.0, 0), (2.0, None)], "s double, y int")
    assert ordering.exact_quantile(df, "s", 0.5) == 1.0
    assert ev.evaluate(df, "s", "y", 0.5).first()["n_samples"] == 2


def test_split_is_disjoint_complete_and_even(spark, skewed):
    s, y = skewed
    parts = []
    for layout in (1, 11):
        df = stratified_split(table(spark, s, y, layout), "k", "y", 0.2, validation=0.1)
        parts.append({r["k"]: (r["split"], r["y"]) for r in df.collect()})
    assert parts[0] == parts[1] and len(parts[0]) == len(s)
    for label in (0, 1):
        chosen = [p for p, v in parts[0].values() if v == label]
        assert chosen.count("test") == pytest.approx(0.2 * len(chosen), abs=1.01)
        assert chosen.count("validation") == pytest.approx(0.1 * len(chosen), abs=2.01)


def test_threshold_grid_equals_brute_force(spark, skewed):
    from tidewatch.operators.calibrate import threshold_grid

    s, y = skewed
    best, limit = 0.0, 0.0
    for t in np.linspace(s.min(), s.max(), 200):
        hit = s >= t
        f1 = 2 * (y[hit].sum()) / (hit.sum() + y.sum())
        if f1 > best:
            best, limit = f1, t
    row = threshold_grid(table(spark, s, y), "s", "y").first()
    assert row["f1"] == pytest.approx(best) and row["threshold"] == pytest.approx(limit)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_scan_reads_only_what_is_needed(spark, folder):
    from tidewatch.sources import views

    text = plan(views.flows(spark, folder).select("flow_id", "bytes_out").where("flow_id > 100"))
    assert "l_quantity" not in text.split("== Physical Plan ==")[1] and "PushedFilters" in text
    assert "GreaterThan(o_orderkey,100)" in text


def test_no_plan_has_a_cross_join(spark, folder):
    from tidewatch.plans import catalog

    for name in ("evaluation_row", "alerts_flows", "pr_curve", "row_index", "value_counts_service"):
        text = plan(catalog.QUERIES[name](spark, folder))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scores_stay_in_compiled_stages(spark, folder):
    from tidewatch.plans import catalog

    text = plan(catalog.QUERIES["zscore_scores"](spark, folder)).split("== Physical Plan ==")[1]
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text


def test_stored_tables_leave_no_shuffle_files(spark):
    """What a stored table was shuffled through goes with the write, not with some later garbage collection."""
    import time

    from tidewatch.session import SHUFFLE_CLEANUP, durable

    def held() -> set[str]:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.length()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    set_before, before = spark.conf.get(SHUFFLE_CLEANUP, None), held()
    rows = spark.range(20_000).withColumn("k", F.col("id") % 50)
    stored = durable(rows.repartition(5, "k").groupBy("k").count().repartition(3, "count", "k"))
    end = time.time() + 20
    while held() - before and time.time() < end:  # files are removed while the driver goes on
        time.sleep(0.1)
    assert not held() - before
    assert stored.agg(F.sum("count")).first()[0] == 20_000 and spark.conf.get(SHUFFLE_CLEANUP, None) == set_before
