from __future__ import annotations

import math

import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from tidewatch.detectors.iforest import IsolationForest
from tidewatch.detectors.mlp import MlpReconstruction
from tidewatch.detectors.text import LogTextDetector, term_bucket
from tidewatch.operators.features import only_normal
from tidewatch.operators.sampling import background_sample
from tidewatch.plans import catalog
from tidewatch.plans.process import Pipeline
from tidewatch.schemas import METRIC_FEATURES


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"Failed password for root from 10.0.0.{i} port {i}" if i % 5 == 0 else f"session {i} opened for user", i % 5 == 0, "auth", None)
            for i in range(100)]
    rows += [(200, None, None, "auth", None), (201, "", None, "auth", None), (202, "ünï 日本 😀 abcd abcde abcdefg", None, "auth", None)]
    return spark.createDataFrame(rows, "log_id long, message string, is_anomaly boolean, source string, anomaly_type string").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp"))


def test_buckets_are_those_of_the_library(spark):
    hashing = HashingTF(numFeatures=1 << 16)
    for term in ["", "a", "ab", "abc", "abcd", "password", "größe", "日本", "😀", "x" * 101]:
        assert term_bucket(term, 1 << 16) == hashing.indexOf(term)


def test_terms_add_up_to_the_log_odds(texts):
    detector = LogTextDetector(iterations=20).fit(texts)
    found = detector.term_attribution(detector.score(texts), top=100, raw="raw", base="base").collect()
    assert len(found) == 103
    for r in found:
        assert r["raw"] == pytest.approx(math.log(r["score"] / (1 - r["score"])), abs=1e-6)
        assert r["base"] + sum(e["value"] for e in r["attribution"]) == pytest.approx(r["raw"], abs=1e-9)
        sizes = [abs(e["value"]) for e in r["attribution"]]
        assert sizes == sorted(sizes, reverse=True)
    failed = next(r for r in found if r["log_id"] == 5)
    assert {e["feature"] for e in failed["attribution"] if e["value"] > 0} >= {"failed", "password", "root"}
    assert detector.term_attribution(texts, top=2).where(F.size("attribution") > 2).isEmpty()


def test_sure_scores_have_odds_too(spark, monkeypatch):
    """Scores that long texts round to 0 or 1: a term moves the odds by more than a double between them can hold."""
    cases = {1: (1.0, 45.0), 2: (0.0, -45.0), 3: (0.25, math.log(1 / 3)), 4: (1 - 2.0 ** -53, 36.7), 5: (1e-300, -690.0), 6: (0.5, 1.0)}
    rows = spark.createDataFrame([(i, score, [("word", total - 1.0)], 1.0) for i, (score, total) in cases.items()],
                                 "log_id long, score double, attribution array<struct<feature: string, value: double>>, base double")
    monkeypatch.setattr(catalog, "_term_attributed", lambda *_: rows)
    found = {r["log_id"]: r["gap"] for r in catalog.QUERIES["term_attribution_sums"](spark, "").collect()}
    assert found == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 1.0}


def test_counts_made_before_a_join_score_alike(texts):
    detector = LogTextDetector(iterations=20).fit(texts)
    other = LogTextDetector(iterations=20)
    other.fit(other.hashed(texts).drop("message"))
    score = lambda d, df: {r["log_id"]: r["score"] for r in d.score(df).collect()}
    assert score(other, other.hashed(texts).drop("message")) == pytest.approx(score(detector, texts))


def top_of(alerts):
    return {r["id"]: r["top_features"] for r in alerts.collect()}


def test_alerts_of_any_detector_are_explained(spark, folder, texts):
    rows = catalog.metric_view(spark, folder)
    normals = only_normal(rows)
    forest = IsolationForest(METRIC_FEATURES, trees=20, sample=64).fit(normals, "rec_id")
    network = MlpReconstruction(METRIC_FEATURES, (4,), epochs=2).fit(normals)
    by_tree = Pipeline("metric", "rec_id", {"score": forest}, forest.threshold, features=METRIC_FEATURES).alerts(rows)
    assert by_tree.where(F.size("shap_attribution") != len(METRIC_FEATURES)).isEmpty() and not by_tree.isEmpty()
    assert by_tree.where(F.col("top_features") != F.slice(F.transform("shap_attribution", lambda e: e["feature"]), 1, 3)).isEmpty()
    background = background_sample(rows, "rec_id", 20)
    plans = {b: Pipeline("metric", "rec_id", {"score": network}, network.threshold, features=METRIC_FEATURES, background=b and background) for b in (True, None)}
    explained, largest = plans[True].alerts(rows.limit(200)), plans[None].alerts(rows.limit(200))
    assert set(top_of(explained)) == set(top_of(largest)) != set()
    for r in largest.collect():  # without a background: by absolute value
        values = {e["feature"]: e["value"] for e in r["shap_attribution"]}
        assert r["top_features"] == sorted(METRIC_FEATURES, key=lambda c: (-abs(values[c]), METRIC_FEATURES.index(c)))[:3]
        assert set(r["feature_values"]) == set(r["top_features"])
    detector = LogTextDetector(iterations=20).fit(texts)
    logs = Pipeline("log", "log_id", {"score": detector}, detector.threshold, explain=True, features=["source"]).alerts(texts)
    assert logs.count() == 20 and all("password" in [e["feature"] for e in r["shap_attribution"]] for r in logs.collect())


def test_no_text_below_an_exchange(spark, folder):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        detector = LogTextDetector()
        for df in (
            catalog.QUERIES["feed_view"](spark, folder), catalog.QUERIES["sampled_messages"](spark, folder), catalog._counted_logs(spark, folder, detector),
        ):
            plan = df._jdf.queryExecution().executedPlan().toString()
            for line in plan.split("== Initial Plan ==")[0].split("\n"):
                if "Exchange" in line or "Sort [" in line:
                    assert "text#" not in line
            joins = [part for part in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in part]
            above = df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
            assert joins and "text#" not in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
