"""Hand-worked cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import fusion
from tidewatch.functions.records import log_anomaly_type, severity_rank
from tidewatch.operators import alerts as al
from tidewatch.operators import calibrate as cal
from tidewatch.operators import evaluate as ev
from tidewatch.operators import features as fe
from tidewatch.operators import federated as fed
from tidewatch.operators import fuse, knowledge, ordering, profile, scaling
from tidewatch.schemas import ALERT_SCHEMA, DERIVED_FLOW_FEATURES, ROUND_SCHEMA


def flow(spark, **values):
    row = {"bytes_out": 0, "bytes_in": 0, "packets": 0, "duration_ms": 0, "dst_port": 0} | values
    schema = ", ".join(f"{k} long" for k in row)
    return fe.add_network_features(spark.createDataFrame([tuple(row.values())], schema)).first()


def scores(spark, values, labels):
    return spark.createDataFrame(list(zip(map(float, values), labels)), "s double, y int")


def test_empty_flow(spark):
    row = flow(spark)
    assert [row[c] for c in DERIVED_FLOW_FEATURES] == [0, 0, 0, 0, 0, 0, 0, 0, 1]


def test_null_and_absent_columns_count_as_zero(spark):
    df = spark.createDataFrame([(None, 10)], "bytes_out long, bytes_in long")
    row = fe.add_network_features(df).first()
    assert all(row[c] is not None for c in DERIVED_FLOW_FEATURES)
    assert row["bytes_per_packet"] == 10 and row["byte_asymmetry"] == pytest.approx(10 / 11)


def test_rates_are_clipped(spark):
    row = flow(spark, bytes_out=500_000_000, duration_ms=1)
    assert row["bytes_per_sec"] == 1e6 and row["payload_density"] == 1e5


@pytest.mark.parametrize("port, flags", [(443, (1, 0)), (4444, (0, 1)), (8888, (0, 0))])
def test_port_flags(spark, port, flags):
    row = flow(spark, dst_port=port)
    assert (row["is_common_port"], row["is_suspicious_port"]) == flags


def test_features_are_idempotent(spark):
    once = fe.add_network_features(spark.createDataFrame([(7, 3, 2, 40, 53)], "bytes_out long, bytes_in long, packets long, duration_ms long, dst_port long"))
    assert once.first() == fe.add_network_features(once).select(once.columns).first()


def test_missing_feature_is_an_error(spark):
    with pytest.raises(ValueError, match="missing"):
        fe.select_features(spark.range(1), ["cpu_percent"])


def test_external_flow_clips_negatives(spark):
    df = spark.createDataFrame([(-5, 10, 1, 1, 0.5, 8.0)], "sbytes long, dbytes long, spkts long, dpkts long, dur double, smean double")
    row = fe.map_flow_csv(df).first()
    assert row["bytes_out"] == 0 and row["packets"] == 2 and row["duration_ms"] == 500
    assert row["payload_density"] == pytest.approx(8.0 / 0.51) and row["dst_port"] == 0


@pytest.mark.parametrize("kind, text, expected", [
    ("syslog", "Failed password", "brute_force"), ("syslog", "sudo", "privilege_escalation"),
    ("auth", "Invalid user x", "invalid_user"), ("auth", "invalid user", "auth_failure"),
    ("apache", "GET /etc/passwd UNION", "path_traversal"), ("apache", "UNION SELECT", "sqli"),
    ("apache", "?cmd=ls", "web_shell"), ("apache", "GET /", "unauthorized_access"), ("other", "Failed", None),
])
def test_log_rules(spark, kind, text, expected):
    df = spark.createDataFrame([(kind, text)], "log_type string, message string")
    assert df.select(log_anomaly_type(F.col("log_type"), F.col("message"))).first()[0] == expected


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_supervised_fusion(spark):
    assert one(spark, fusion.supervised(F.lit(1.0), F.lit(0.2), 0.2)) == pytest.approx(0.8)
    assert one(spark, fusion.supervised(F.lit(1.0), F.lit(None).cast("double"), 0.2)) is None


def test_ratio_fusion(spark):
    assert one(spark, fusion.threshold_ratio(F.lit(0.4), F.lit(2.0), 0.4, 2.0)) == pytest.approx(0.5)
    assert one(spark, fusion.threshold_ratio(F.lit(9.0), F.lit(9.0), 1.0, 1.0)) == 1.0


def test_weighted_and_vote(spark):
    df = spark.createDataFrame([(0.5, 0.6, None)], "if_score double, ae_score double, bert_score double")
    assert fuse.fuse_dataframe(df).first()["fused_score"] == pytest.approx(0.55)
    votes = {"if_score": F.lit(0.6), "ae_score": F.lit(0.4), "bert_score": F.lit(0.5)}
    assert one(spark, fusion.vote(votes)) == pytest.approx(2 / 3)


def test_fusion_argument_errors(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        fusion.weighted({"if_score": F.lit(1.0)}, {"if_score": 0.5})
    with pytest.raises(ValueError, match="at least one"):
        fuse.fuse_dataframe(spark.range(1))
    with pytest.raises(ValueError, match="strategy"):
        fusion.by_strategy("median", {"if_score": F.lit(1.0)})


def test_minmax(spark):
    constant = spark.createDataFrame([(4.0,)] * 3, "s double")
    assert [r[0] for r in scaling.minmax_normalize(constant, ["s"]).collect()] == [0, 0, 0]
    assert scaling.minmax_normalize(spark.createDataFrame([(0.37,)], "s double"), ["s"]).first()[0] == 0.37


def test_constant_feature_is_divided_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = scaling.Standardizer.fit(df, ["a", "b"])
    assert scaler.std == [1.0, 1.0] and [tuple(r) for r in scaler.transform(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_route_ladder(spark):
    df = spark.createDataFrame([(1.0, None, 0.3), (None, None, None)], "sup_score double, ae_score double, if_score double")
    out = [r[0] for r in fuse.route_fusion(df, reconstruction_threshold=1.0, isolation_threshold=1.0).select("fused_score").collect()]
    assert out == [0.3, 0.0]
    with pytest.raises(ValueError):
        fuse.route_fusion(df, "video")


def test_auc_cases(spark):
    ties = ev.ranking_metrics(scores(spark, [1, 1, 2, 2], [0, 1, 0, 1]), "s", "y").first()
    assert ties["roc_auc"] == 0.5
    single = ev.ranking_metrics(scores(spark, [1, 2], [0, 0]), "s", "y").first()
    assert single["roc_auc"] == 0.0 and single["avg_precision"] == 0.0


def test_average_precision_and_threshold(spark):
    df = scores(spark, [0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1])
    assert ev.ranking_metrics(df, "s", "y").first()["avg_precision"] == pytest.approx(0.8333333)
    best = cal.threshold_max_f1(df, "s", "y", 0.9).first()
    assert best["threshold"] == 0.35 and best["recall"] == 1.0 and best["f1"] == pytest.approx(0.8)


def test_threshold_tie_takes_the_lowest(spark):
    df = scores(spark, [3, 2, 2, 1], [1, 1, 0, 0])
    f1 = {0: None}
    points = {r["threshold"]: r for r in ev.pr_curve(df, "s", "y").collect()}
    for t in (3.0, 2.0):
        p, r = points[t]["precision"], points[t]["recall"]
        f1[t] = 2 * p * r / (p + r)
    assert f1[2.0] > f1[3.0]
    even = scores(spark, [4, 3, 2, 1], [1, 0, 0, 1])  # F1 is 2/3 at 4 and at 1
    assert cal.threshold_max_f1(even, "s", "y").first()["threshold"] == 1.0


def test_threshold_edge_cases(spark):
    assert cal.threshold_max_f1(scores(spark, [1, 2], [0, 0]), "s", "y").first()["threshold"] is None
    with pytest.raises(ValueError):
        cal.threshold_max_f1(scores(spark, [1], [1]), "s", "y", 1.5)
    df = scores(spark, [0.9, 0.8, 0.2], [1, 1, 0])
    assert cal.threshold_at_recall(df, "s", "y", 0.95).first()["threshold"] == 0.8


def test_pr_curve_closing_point(spark):
    rows = ev.pr_curve(scores(spark, [1, 2], [0, 1]), "s", "y").collect()
    assert (None, 1.0, 0.0) in [tuple(r) for r in rows] and len(rows) == 3


def test_severity_counts_without_alerts(spark):
    empty = spark.createDataFrame([], ALERT_SCHEMA)
    assert {(r["severity"], r["n"]) for r in al.count_by_severity(empty).collect()} == {
        (s, 0) for s in ("low", "medium", "high", "critical")
    }


def test_decide_modes(spark):
    df = spark.createDataFrame([(0.9, None), (0.9, False), (0.1, True), (None, None)], "s double, is_anomaly boolean")
    def flags(mode):
        return [r["is_alert"] for r in al.decide(df, "s", 0.5, mode).collect()]
    assert flags("label_first") == [True, False, True, False]
    assert flags("model") == [True, True, False, False]
    with pytest.raises(ValueError):
        al.decide(df, "s", 0.5, "guess")


def test_unknown_type_and_rank(spark):
    df = spark.createDataFrame([(None,), ("xyz",), ("sqli",)], "anomaly_type string")
    rows = knowledge.attach_attack_knowledge(df).collect()
    assert sorted((r["tactic"], r["severity"]) for r in rows) == [("Collection", "critical"), ("Unknown", "medium"), ("Unknown", "medium")]
    assert one(spark, severity_rank(F.lit("critical"))) == 4 and one(spark, severity_rank(F.lit("odd"))) == 0
    assert knowledge.by_tactic(knowledge.knowledge(spark), "Impact").count() == 5


def test_severity_and_limit_are_checked(spark):
    empty = spark.createDataFrame([], ALERT_SCHEMA)
    for bad in (lambda: al.latest_alerts(empty, 10, "urgent"), lambda: al.latest_alerts(empty, 5000)):
        with pytest.raises(ValueError):
            bad()
    assert al.get_alert(empty, "nothing").count() == 0


def test_client_split(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    sizes = {r["client"]: r["count"] for r in ordering.partition_clients(df, 3, ["k"]).groupBy("client").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 5}
    few = ordering.partition_clients(spark.range(2).withColumnRenamed("id", "k"), 3, ["k"])
    assert {r["client"] for r in few.collect()} == {2}


def test_fedavg(spark):
    schema = "client int, n_examples long, layer int, values array<double>"
    df = spark.createDataFrame([(0, 1, 0, [1.0, 0.0]), (1, 2, 0, [4.0, 3.0])], schema)
    assert fed.fedavg(df).first()["values"] == [3.0, 2.0]
    alone = spark.createDataFrame([(0, 7, 0, [1.5, -2.0])], schema)
    assert fed.fedavg(alone).first()["values"] == [1.5, -2.0]


def test_federated_status(spark):
    empty = fed.federated_status(spark.createDataFrame([], ROUND_SCHEMA)).first()
    assert empty["current_round"] == 0 and empty["nodes"] == []
    full = fed.federated_status(spark.createDataFrame([(1, 3, 0.5, 100), (2, 3, 0.4, 100)], ROUND_SCHEMA)).first()
    assert full["current_round"] == 2 and [n["n_samples"] for n in full["nodes"]] == [33, 33, 33]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3)], "v double")
    assert {r["bin"]: r["n"] for r in profile.histogram(df, "v", 3).collect()} == {0: 1, 1: 1, 2: 2}


def test_report_without_predictions(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "p int, y int")
    rows = {r["class"]: r for r in ev.classification_report(df, "p", "y").collect()}
    assert rows["1"]["precision"] == 0.0 and rows["1"]["f1"] == 0.0 and rows["accuracy"]["f1"] == 0.5
