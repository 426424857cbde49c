"""All registered queries: each reads the given tables and returns a DataFrame.

Every query has a closed-form SQL counterpart in ``oracle`` where there is one. Values that different
engines add up in different orders are rounded to six places, and nested values are shown as rows or text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.detectors.base import batch_score, custom_score
from tidewatch.detectors.boosted import BoostedTrees
from tidewatch.detectors.iforest import IsolationForest
from tidewatch.detectors.mlp import MlpReconstruction
from tidewatch.detectors.pca import PcaReconstruction
from tidewatch.detectors.text import LogTextDetector
from tidewatch.detectors.zscore import ZScoreDetector
from tidewatch.functions import fusion, records
from tidewatch.functions import sql as sql_functions_module
from tidewatch.operators import alerts as al
from tidewatch.operators import calibrate as cal
from tidewatch.operators import evaluate as ev
from tidewatch.operators import explain as xp
from tidewatch.operators import features as fe
from tidewatch.operators import federated as fed
from tidewatch.operators import fuse, knowledge, ordering, profile, sampling, scaling
from tidewatch.operators.shapley import shapley, tree_shapley
from tidewatch.plans.process import Pipeline
from tidewatch.schemas import ALERT_SCHEMA, DERIVED_FLOW_FEATURES, FLOW_FEATURES, METRIC_FEATURES
from tidewatch.session import durable, remove_at_exit, shared_folder, tune
from tidewatch.sources import views
from tidewatch.sources.alert_store import AlertStore
from tidewatch.sources.views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    @wraps(run)
    def tuned(spark: SparkSession, folder: str) -> DataFrame:
        return run(tune(spark), folder)

    QUERIES[run.__name__] = tuned
    return tuned


def rounded(df: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


# ---- shared starting points ---------------------------------------------------------------------

# A fit reads its table several times. The flows and metrics views end in a shuffle, so where a query fits a
# model on them they are written once, and every later pass is a narrow read without that shuffle.

def flow_view(spark: SparkSession, folder: str) -> DataFrame:
    return durable(views.flows(spark, folder))


def metric_view(spark: SparkSession, folder: str) -> DataFrame:
    return durable(views.metrics(spark, folder))


def flow_rows(spark: SparkSession, folder: str) -> DataFrame:
    return fe.add_network_features(flow_view(spark, folder))


def flow_model(spark: SparkSession, folder: str, fraction: float | None = 0.92) -> tuple[DataFrame, ZScoreDetector]:
    rows = flow_rows(spark, folder)
    return rows, ZScoreDetector(FLOW_FEATURES).fit(fe.only_normal(rows), fraction)


def metric_model(spark: SparkSession, folder: str, fraction: float | None = 0.92) -> tuple[DataFrame, ZScoreDetector]:
    rows = metric_view(spark, folder)
    return rows, ZScoreDetector(METRIC_FEATURES).fit(fe.only_normal(rows), fraction)


def log_model(spark: SparkSession, folder: str, message: Column | None = None) -> tuple[DataFrame, ZScoreDetector]:
    """``message`` is what is kept of the text, by default all of it."""
    rows = views.logs(spark, folder, {"message_length": F.length("text")}, message)
    lengths = durable(rows.select("message_length", "is_anomaly"))  # the fit reads the texts once
    return rows, ZScoreDetector(["message_length"]).fit(fe.only_normal(lengths))


def metric_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Three scores per metric record; the third is absent where a host had a single connection."""
    rows = metric_view(spark, folder)
    scaler = scaling.Standardizer.fit(fe.only_normal(rows), METRIC_FEATURES)
    detectors = {
        "if_score": ZScoreDetector(METRIC_FEATURES[:4], scaler),
        "ae_score": ZScoreDetector(METRIC_FEATURES, scaler),
        "bert_score": ZScoreDetector(METRIC_FEATURES[4:], scaler),
    }
    scored = batch_score(rows, detectors)
    return scored.withColumn("bert_score", F.when(F.col("open_connections") > 1, F.col("bert_score")))


def flow_predictions(spark: SparkSession, folder: str) -> tuple[DataFrame, float]:
    rows, detector = flow_model(spark, folder)
    return detector.predict(rows), detector.threshold


def flow_pipeline(spark: SparkSession, folder: str) -> tuple[DataFrame, Pipeline]:
    raw = flow_view(spark, folder)
    detector = ZScoreDetector(FLOW_FEATURES).fit(fe.only_normal(fe.add_network_features(raw)))
    return raw, Pipeline("network", "flow_id", {"if_score": detector}, detector.threshold,
                         features=["src_ip", "dst_ip", "dst_port"])


def metric_pipeline(spark: SparkSession, folder: str) -> tuple[DataFrame, Pipeline]:
    rows, detector = metric_model(spark, folder)
    return rows, Pipeline("metric", "rec_id", {"score": detector}, detector.threshold, features=METRIC_FEATURES)


def log_pipeline(spark: SparkSession, folder: str, message: Column | None = None) -> tuple[DataFrame, Pipeline]:
    rows, detector = log_model(spark, folder, message)
    return rows, Pipeline("log", "log_id", {"score": detector}, detector.threshold, mode="label_first",
                          features=["source", "log_type", "message_length"])


def flow_alerts(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan = flow_pipeline(spark, folder)
    return plan.alerts(rows)


def metric_alerts(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan = metric_pipeline(spark, folder)
    return plan.alerts(rows)


def every_alert(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan = log_pipeline(spark, folder)
    return al.union_modalities(flow_alerts(spark, folder), metric_alerts(spark, folder), plan.alerts(rows))


_MADE: dict[tuple, object] = {}


def once(make: Callable) -> Callable:
    """What is fitted or stored for a folder is made by the first query of a session that needs it and then used by all."""
    @wraps(make)
    def made(spark: SparkSession, folder: str):
        key = (spark.sparkContext.applicationId, folder, make.__name__)
        if key not in _MADE:
            _MADE[key] = make(spark, folder)
        return _MADE[key]

    return made


@once
def alert_store(spark: SparkSession, folder: str) -> AlertStore:
    """The alerts of all modalities, as the pipelines would have stored them."""
    store = AlertStore(spark, f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}")
    remove_at_exit(spark, store.path)
    store.upsert(every_alert(spark, folder))
    store.merge()
    return store


def acks(spark: SparkSession, folder: str) -> DataFrame:
    """Acknowledgements read off all order lines: several per order, and many for orders without an alert."""
    return table(spark, folder, "lineitem").select(
        al.alert_id("network", F.col("l_orderkey")).alias("alert_id"),
        F.concat(F.lit("operator-"), (F.col("l_suppkey") % 5).cast("string")).alias("acknowledged_by"),
        F.when(F.col("l_returnflag") == "R", "false alarm").alias("note"),
        F.col("l_shipdate").cast("timestamp").alias("acknowledged_at"),
    )


# ---- features and cleaning ----------------------------------------------------------------------

@query
def network_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = fe.fill_missing(views.flows(spark, folder), ["bytes_out", "bytes_in", "packets", "duration_ms"])
    return rounded(fe.add_network_features(rows).select("flow_id", *DERIVED_FLOW_FEATURES), [
        c for c in DERIVED_FLOW_FEATURES if not c.startswith("is_")
    ])


@query
def external_flow_features(spark: SparkSession, folder: str) -> DataFrame:
    mapped = fe.map_flow_csv(views.external_flows(spark, folder), keep=["flow_id"])
    return rounded(mapped, FLOW_FEATURES)


@query
def selected_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fe.select_features(views.flows(spark, folder), ["bytes_out", "duration_ms"], ["flow_id"]),
                   ["bytes_out", "duration_ms"])


@query
def standardized_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.metrics(spark, folder)
    scaler = scaling.Standardizer.fit(fe.only_normal(rows), METRIC_FEATURES)
    return rounded(scaler.transform(rows).select("rec_id", *METRIC_FEATURES), METRIC_FEATURES)


@query
def service_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return fe.service_name(views.flows(spark, folder)).select("flow_id", "dst_port", "service")


@query
def log_rules(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.get(F.lit(["syslog", "auth", "apache"]), (F.col("page_id") % 3).cast("int"))
    rows = table(spark, folder, "pages").select("page_id", kind.alias("log_type"), F.col("html").alias("message"))
    return fe.classify_log_message(rows).select("page_id", "log_type", "anomaly_type")


@query
def message_lengths(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("log_id"), F.col("text").alias("message"))
    return fe.message_length(rows).select("log_id", "message_length")


@query
def record_origins(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        fe.source_of(rows).select(
            F.lit(modality).alias("modality"), F.col(key).alias("key"), "origin",
            F.coalesce(records.label_int(F.col("is_anomaly")), F.lit(-1)).alias("label"),
        )
        for modality, key, rows in [
            ("network", "flow_id", views.flows(spark, folder)),
            ("metric", "rec_id", views.metrics(spark, folder)),
            ("log", "log_id", views.logs(spark, folder)),
        ]
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- profiling ----------------------------------------------------------------------------------

@query
def class_ranges(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = metric_model(spark, folder, None)
    found = profile.class_ranges(detector.score(rows), "score", "is_anomaly")
    return rounded(found, [c for c in found.columns if c != "overlap"])


@query
def class_means(spark: SparkSession, folder: str) -> DataFrame:
    found = profile.class_means(views.metrics(spark, folder), METRIC_FEATURES, "is_anomaly")
    return rounded(found, ["normal_mean", "anomaly_mean"])


@query
def feature_histogram(spark: SparkSession, folder: str) -> DataFrame:
    found = profile.histogram(views.metrics(spark, folder), "mem_percent", 30, by="is_anomaly")
    return rounded(found, ["bin_start"])


@query
def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.correlation_matrix(views.metrics(spark, folder), METRIC_FEATURES), ["r"])


@query
def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    return profile.dataset_summary({
        "network": views.flows(spark, folder), "metric": views.metrics(spark, folder), "log": views.logs(spark, folder),
    })


@query
def value_counts_service(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.value_counts(fe.service_name(views.flows(spark, folder)), "service"), ["share"])


@query
def top_ports(spark: SparkSession, folder: str) -> DataFrame:
    return profile.top_values(views.flows(spark, folder), "dst_port", 10)


@query
def zscore_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = metric_scores(spark, folder)
    names = ["if_score", "ae_score", "bert_score"]
    return rounded(scored.select("rec_id", *names), names)


@query
def score_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = metric_model(spark, folder, None)
    return rounded(profile.score_percentiles(detector.score(rows), "score"), ["value"])


@query
def score_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = metric_model(spark, folder)
    found = profile.score_stats(detector.score(rows), "score", detector.threshold)
    return rounded(found, ["min", "max", "mean", "share_above"])


# ---- normalisation and fusion -------------------------------------------------------------------

@query
def bounds_normalized(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = metric_model(spark, folder)
    scored = detector.score(rows).withColumn("normalized", detector.normalized(F.col("score")))
    return rounded(scored.select("rec_id", "normalized"), ["normalized"])


@query
def minmax_normalized(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = metric_model(spark, folder, None)
    scaled = scaling.minmax_normalize(detector.score(rows), ["score"])
    return rounded(scaled.select("rec_id", "score"), ["score"])


def _fused(spark: SparkSession, folder: str, strategy: str) -> DataFrame:
    fused = fuse.fuse_dataframe(metric_scores(spark, folder), strategy)
    return rounded(fused.select("rec_id", "fused_score", "is_anomaly_pred"), ["fused_score"])


@query
def fuse_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder, "weighted_avg")


@query
def fuse_max(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder, "max")


@query
def fuse_vote(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder, "vote")


def _score_quantiles(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Quantile of several score columns over the normals, from one long table."""
    long = ev.stack_scores(fe.only_normal(df), {c: c for c in names}, "is_anomaly")
    return {k[0]: v[0.92] for k, v in ordering.exact_quantiles(long, "score", [0.92], ["detector"]).items()}


@query
def fuse_supervised(spark: SparkSession, folder: str) -> DataFrame:
    scored = metric_scores(spark, folder)
    limit = _score_quantiles(scored, ["ae_score"])["ae_score"]
    fused = fusion.supervised(F.col("bert_score"), F.col("ae_score"), limit)
    return rounded(scored.select("rec_id", fused.alias("fused_score")), ["fused_score"])


@query
def fuse_ratio(spark: SparkSession, folder: str) -> DataFrame:
    scored = metric_scores(spark, folder)
    limits = _score_quantiles(scored, ["if_score", "ae_score"])
    fused = fusion.threshold_ratio(F.col("if_score"), F.col("ae_score"), limits["if_score"], limits["ae_score"])
    return rounded(scored.select("rec_id", fused.alias("fused_score")), ["fused_score"])


@query
def fuse_routed(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with all scores, rows without a classifier, rows with one score only, and rows with none."""
    scored = metric_scores(spark, folder)
    limits = _score_quantiles(scored, ["if_score", "ae_score"])
    group = F.col("rec_id") % 4
    partial = scored.select(
        "rec_id",
        F.when(group == 0, F.col("bert_score")).alias("sup_score"),
        F.when(group < 2, F.col("ae_score")).alias("ae_score"),
        F.when(group < 3, F.col("if_score")).alias("if_score"),
    )
    fused = fuse.route_fusion(
        partial, "network", reconstruction_threshold=limits["ae_score"], isolation_threshold=limits["if_score"]
    )
    return rounded(fused.select("rec_id", "fused_score"), ["fused_score"])


@query
def fuse_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Scores computed apart, on different subsets of records, joined on the record and fused."""
    scored = metric_scores(spark, folder)
    frames = [
        scored.where(F.col("rec_id") % 2 == 0).select("rec_id", "if_score"),
        scored.where(F.col("rec_id") % 3 == 0).select("rec_id", "ae_score"),
        scored.where(F.col("bert_score").isNotNull()).select("rec_id", "bert_score"),
    ]
    fused = fuse.fuse_dataframe(fuse.join_scores(frames, "rec_id"))
    return rounded(fused.select("rec_id", "fused_score", "is_anomaly_pred"), ["fused_score"])


@query
def fuse_positional(spark: SparkSession, folder: str) -> DataFrame:
    """Metric and log scores paired by position, as far as the shorter table goes."""
    rows, metric = metric_model(spark, folder, None)
    texts, log = log_model(spark, folder)
    left = metric.score(rows, "ae_score").select("rec_id", "ae_score")
    right = log.score(texts, "bert_score").select("log_id", "bert_score")
    paired = ordering.align_by_position(left, right, ["rec_id"], ["log_id"])
    fused = fuse.fuse_dataframe(paired)
    return rounded(fused.select("row_index", "rec_id", "log_id", "fused_score"), ["fused_score"])


@query
def compare_strategies(spark: SparkSession, folder: str) -> DataFrame:
    scored = metric_scores(spark, folder)
    names = ["if_score", "ae_score", "bert_score"]
    scaled = scaling.minmax_normalize(scored.select("is_anomaly", *names), names)
    present = {c: F.col(c) for c in names}
    fused = scaled.withColumns({s: fusion.by_strategy(s, present) for s in ("weighted_avg", "max", "vote")})
    return ev.compare_strategies(fused, {s: s for s in ("weighted_avg", "max", "vote")}, "is_anomaly")


@query
def compare_detectors(spark: SparkSession, folder: str) -> DataFrame:
    scored = metric_scores(spark, folder)
    names = ["if_score", "ae_score", "bert_score"]
    return ev.compare_detectors(scored, {c: c for c in names}, "is_anomaly", _score_quantiles(scored, names))


# ---- curves and thresholds ----------------------------------------------------------------------

def _event_scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("value", (F.col("event_type") == "error").alias("is_error"))


@query
def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    found = ev.pr_curve(_event_scores(spark, folder), "value", "is_error")
    return rounded(found, ["precision", "recall"])


@query
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.roc_curve(_event_scores(spark, folder), "value", "is_error"), ["fpr", "tpr"])


@query
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = metric_model(spark, folder, None)
    return rounded(ev.ranking_metrics(detector.score(rows), "score", "is_anomaly").select("roc_auc"), ["roc_auc"])


@query
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    found = ev.ranking_metrics(_event_scores(spark, folder), "value", "is_error")
    return rounded(found, ["roc_auc", "avg_precision"])


@query
def threshold_f1(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = flow_model(spark, folder, None)
    found = cal.threshold_max_f1(detector.score(rows), "score", "is_anomaly", 0.90)
    return rounded(found, ["threshold", "f1", "recall"])


@query
def threshold_percentile(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = flow_model(spark, folder)
    return rows.agg(F.round(F.lit(detector.threshold), 6).alias("threshold"), F.count("*").alias("n"))


@query
def threshold_clipped(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = metric_model(spark, folder, None)
    found = cal.threshold_clipped(detector.score(rows), "score", "is_anomaly", 0.90)
    return rounded(found, ["threshold", "f1", "recall", "score_clip"])


@query
def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = metric_model(spark, folder, None)
    return rounded(cal.threshold_grid(detector.score(rows), "score", "is_anomaly"), ["threshold", "f1"])


@query
def threshold_recall(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = flow_model(spark, folder, None)
    return rounded(cal.threshold_at_recall(detector.score(rows), "score", "is_anomaly", 0.95), ["threshold"])


@query
def calibrated_config(spark: SparkSession, folder: str) -> DataFrame:
    rows, metric = metric_model(spark, folder, None)
    packets, network = flow_model(spark, folder, None)
    config = cal.calibrate_pipeline({"metric": metric.score(rows), "network": network.score(packets)}, "score", "is_anomaly")
    labelled = rows.select(F.lit("metric").alias("modality")).unionByName(packets.select(F.lit("network").alias("modality")))
    limit = F.when(F.col("modality") == "network", config.network_threshold).otherwise(config.threshold)
    return rounded(labelled.groupBy("modality").agg(F.count("*").alias("n")).withColumn("threshold", limit), ["threshold"])


# ---- evaluation ---------------------------------------------------------------------------------

@query
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = flow_predictions(spark, folder)
    return rounded(ev.prf(rows, "prediction", "is_anomaly"), ["precision", "recall", "f1"])


@query
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = flow_predictions(spark, folder)
    return rounded(ev.classification_report(rows, "prediction", "is_anomaly"), ["precision", "recall", "f1"])


@query
def evaluation_row(spark: SparkSession, folder: str) -> DataFrame:
    rows, limit = flow_predictions(spark, folder)
    return ev.evaluate(rows, "score", "is_anomaly", limit)


@query
def errors_listing(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = flow_predictions(spark, folder)
    columns = ["flow_id", "anomaly_type", "score", "kind"]
    missed = ev.false_negatives(rows, "prediction", "is_anomaly").withColumn("kind", F.lit("missed")).select(columns)
    false = ev.false_positives(rows, "prediction", "is_anomaly").withColumn("kind", F.lit("false alarm")).select(columns)
    return rounded(missed.unionByName(false), ["score"])


@query
def missed_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = flow_predictions(spark, folder)
    missed = ev.false_negatives(rows, "prediction", "is_anomaly")
    return rounded(missed.groupBy("anomaly_type").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")),
                   ["mean_score"])


@query
def recall_by_type(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = flow_predictions(spark, folder)
    return rounded(ev.recall_by_type(rows, "prediction", "anomaly_type"), ["recall"])


def _two_detectors(spark: SparkSession, folder: str) -> DataFrame:
    """Flows with the predictions of a detector on raw features and of one on all features."""
    rows = flow_rows(spark, folder)
    normals = fe.only_normal(rows)
    raw, full = ZScoreDetector(FLOW_FEATURES[:6]).fit(normals), ZScoreDetector(FLOW_FEATURES).fit(normals)
    return full.predict(raw.predict(rows, "before", "before_score"), "after", "after_score")


@query
def recovery_report(spark: SparkSession, folder: str) -> DataFrame:
    found = ev.recovery_report(_two_detectors(spark, folder), "before", "after", "is_anomaly")
    scores = ["before_score", "after_score"]
    return rounded(found.select("flow_id", "anomaly_type", "outcome", *scores), scores)


@query
def recovered_sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _two_detectors(spark, folder)
    before = ev.false_negatives(rows, "before", "is_anomaly").select("flow_id")
    after = ev.false_negatives(rows, "after", "is_anomaly").select("flow_id")
    won = ev.recovered(before, after, "flow_id").withColumn("outcome", F.lit("recovered"))
    lost = ev.still_missed(before, after, "flow_id").withColumn("outcome", F.lit("still_missed"))
    return won.unionByName(lost)


@query
def verdict(spark: SparkSession, folder: str) -> DataFrame:
    rows, limit = flow_predictions(spark, folder)
    return ev.generalization_verdict(ev.evaluate(rows, "score", "is_anomaly", limit)).select("roc_auc", "recall", "verdict")


@query
def drift_compare(spark: SparkSession, folder: str) -> DataFrame:
    """A detector learned on the even flows, and one learned on all, both evaluated on the odd flows."""
    rows = flow_rows(spark, folder).withColumn("fresh", F.col("flow_id") % 2 == 1)
    old = ZScoreDetector(FLOW_FEATURES).fit(fe.only_normal(rows.where(~F.col("fresh"))))
    new = ZScoreDetector(FLOW_FEATURES).fit(fe.only_normal(rows))
    fresh = rows.where("fresh")
    return ev.drift_compare({
        "before": ev.evaluate(old.score(fresh), "score", "is_anomaly", old.threshold),
        "after": ev.evaluate(new.score(fresh), "score", "is_anomaly", new.threshold),
    })


# ---- alerts -------------------------------------------------------------------------------------

#: The flat fields of an alert, without the narrative and the raw record.
ALERT_VIEW = [f.name for f in ALERT_SCHEMA.fields if f.dataType.typeName() not in ("array", "map") and f.name not in ("narrative", "raw_record")]


def _flat_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select(*ALERT_VIEW, F.concat_ws(",", "top_features").alias("top_features"))


@query
def alerts_flows(spark: SparkSession, folder: str) -> DataFrame:
    return _flat_alerts(flow_alerts(spark, folder))


@query
def alerts_all(spark: SparkSession, folder: str) -> DataFrame:
    return _flat_alerts(every_alert(spark, folder))


@query
def latest_alerts(spark: SparkSession, folder: str) -> DataFrame:
    found = al.latest_alerts(alert_store(spark, folder).read("network"), 100, "critical")
    return found.select("id", "timestamp", "source", "anomaly_type", "fused_score", "severity")


@query
def alert_detail(spark: SparkSession, folder: str) -> DataFrame:
    """The newest alert of each severity looked up by id, and fields of its raw record."""
    store = alert_store(spark, folder)
    newest = store.read("network").groupBy("severity").agg(F.max(F.struct("timestamp", "id"))["id"].alias("id")).collect()  # four severities
    found = al.union_modalities(*[al.get_alert(store.alert(r["id"]), r["id"]) for r in newest] or [al.get_alert(store.read("network"), "")])
    return found.select(
        "id", "timestamp", "source", "anomaly_type", "fused_score", "severity", "mitre_tactic", "mitre_technique",
        F.concat_ws(",", "top_features").alias("top_features"),
        F.try_element_at("feature_values", F.lit("dst_ip")).alias("dst_ip"),
        F.get_json_object("raw_record", "$.bytes_out").cast("long").alias("raw_bytes_out"),
    )


@query
def count_by_severity(spark: SparkSession, folder: str) -> DataFrame:
    """Of the stored flow alerts: features, score, threshold, decision and knowledge join are behind them."""
    return al.count_by_severity(alert_store(spark, folder).read("network"))


@query
def recent_severity(spark: SparkSession, folder: str) -> DataFrame:
    return al.count_by_severity(alert_store(spark, folder).read("metric"), last=100)


@query
def count_by_tactic(spark: SparkSession, folder: str) -> DataFrame:
    return al.count_by_tactic(alert_store(spark, folder).read())


@query
def acked_alerts(spark: SparkSession, folder: str) -> DataFrame:
    found = al.acknowledged_alerts(alert_store(spark, folder).read("network"), acks(spark, folder))
    return found.select("id", "is_acknowledged", "acknowledged_by", "note", "acknowledged_at")


@query
def unacked_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return al.alerts_without_ack(alert_store(spark, folder).read("network"), acks(spark, folder)).select("id", "severity")


@query
def orphan_acks(spark: SparkSession, folder: str) -> DataFrame:
    return al.acks_without_alert(alert_store(spark, folder).read("network"), acks(spark, folder))


@query
def deduped_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Every third alert is written again a day later under the same id."""
    first = metric_alerts(spark, folder).select("id", "timestamp", "source", "severity")
    again = first.where(F.conv(F.substring("id", 1, 1), 16, 10).cast("int") % 3 == 0).select(
        "id", (F.col("timestamp") + F.expr("INTERVAL 1 DAY")).alias("timestamp"), "source", F.lit("low").alias("severity")
    )
    return al.dedupe_alerts(first.unionByName(again))


@query
def dashboard_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan = flow_pipeline(spark, folder)
    return al.dashboard_stats(plan.records(rows), 200, key="flow_id")


@query
def feed_view(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan = log_pipeline(spark, folder, F.substring("text", 1, 60))
    return al.feed_view(plan.scored(rows)).select("log_id", "type", "origin", "title")


@query
def waveform(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan = metric_pipeline(spark, folder)
    return rounded(al.waveform(plan.scored(rows), 80, key="rec_id"), ["value"])


@query
def stream_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan = metric_pipeline(spark, folder)
    return al.stream_stats(plan.scored(rows))


@query
def windowed_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan = metric_pipeline(spark, folder)
    texts, log_plan = log_pipeline(spark, folder)
    columns = ["ts", "modality", "is_alert"]
    both = plan.scored(rows).withColumn("modality", F.lit("metric")).select(columns).unionByName(
        log_plan.scored(texts).withColumn("modality", F.lit("log")).select(columns)
    )
    return al.windowed_stats(both, "1 hour")


@query
def tactics_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Tactics seen in any modality."""
    kinds = [rows.select("anomaly_type").where("is_anomaly") for rows in (
        views.flows(spark, folder), views.metrics(spark, folder), views.logs(spark, folder),
    )]
    seen = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).distinct()
    return knowledge.distinct_tactics(knowledge.attach_attack_knowledge(seen))


# ---- explanation --------------------------------------------------------------------------------

def _attributed(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = metric_model(spark, folder)
    scored = detector.score(rows).where(F.col("score") >= F.lit(detector.threshold))
    return xp.additive_attribution(scored, detector.scaler)


@query
def attribution(spark: SparkSession, folder: str) -> DataFrame:
    return _attributed(spark, folder).select(
        "rec_id", F.posexplode("attribution").alias("place", "entry")
    ).select("rec_id", "place", "entry.feature", "entry.value")


@query
def attribution_bars(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(xp.attribution_bars(_attributed(spark, folder), keep=["rec_id"]), ["pct"], 4)


@query
def global_importance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(xp.global_importance(_attributed(spark, folder)), ["importance"])


def _explained(spark: SparkSession, folder: str) -> DataFrame:
    known = knowledge.attach_attack_knowledge(_attributed(spark, folder))
    return xp.build_explanation(known, METRIC_FEATURES, score="score", origin="host")


@query
def explanations(spark: SparkSession, folder: str) -> DataFrame:
    return _explained(spark, folder).select(
        "rec_id", "source", "anomaly_type", "fused_score", "severity",
        records.severity_rank(F.col("severity")).alias("severity_rank"),
        "mitre_tactic", "mitre_technique_id", F.concat_ws(",", "top_features").alias("top_features"),
        F.round(F.try_element_at("feature_values", F.get("top_features", 0)).cast("double"), 6).alias("top_value"),
    )


@query
def narratives(spark: SparkSession, folder: str) -> DataFrame:
    """Alert narratives of all metrics alerts and explanation narratives, with the numbers in the text masked."""
    def masked(column: str):
        return F.regexp_replace(F.regexp_replace(column, r", score [0-9.]+", ", score #"), r"=-?[0-9]+(\.[0-9]+)?(E-?[0-9]+)?", "=#")

    alert = metric_alerts(spark, folder).select("id", masked("narrative").alias("text"))
    told = xp.explanation_narrative(_explained(spark, folder)).select(
        F.col("rec_id").cast("string").alias("id"), masked("narrative").alias("text")
    )
    return alert.unionByName(told)


@query
def most_anomalous(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = metric_model(spark, folder, None)
    return rounded(xp.most_anomalous(detector.score(rows), "score", "rec_id").select("rec_id", "host", "score"), ["score"])


@query
def top_raw_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.metrics(spark, folder).where("is_anomaly")
    return rows.select("rec_id", F.concat_ws(",", xp.top_heuristic(METRIC_FEATURES)).alias("top_features"))


# ---- order and sampling -------------------------------------------------------------------------

@query
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    split = sampling.stratified_split(views.metrics(spark, folder), "rec_id", "is_anomaly", 0.2, validation=0.1)
    return split.select("rec_id", "split")


@query
def row_index(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.row_index(views.metrics(spark, folder).select("ts", "rec_id"), ["ts", "rec_id"])


@query
def client_partitions(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.metrics(spark, folder).select("ts", "rec_id")
    return ordering.partition_clients(rows, 3, ["ts", "rec_id"]).select("rec_id", "client")


@query
def background_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.background_sample(views.metrics(spark, folder), "rec_id", 200).select("rec_id", "open_connections")


@query
def sampled_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_rows(views.flows(spark, folder), "flow_id", 50, seed=7).select("flow_id", "dst_port")


@query
def sampled_messages(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_per_label(views.logs(spark, folder, message=F.substring("text", 1, 80)), "log_id", "is_anomaly", [True, False], 5)


@query
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return profile.class_weights(views.metrics(spark, folder), "is_anomaly")


# ---- federation ---------------------------------------------------------------------------------

def _client_results(spark: SparkSession, folder: str) -> DataFrame:
    """Per day and client: count, a loss and two rates, in the shape of training results."""
    rows = views.metrics(spark, folder)
    return rows.groupBy(F.dayofmonth("ts").alias("round"), (F.floor(F.col("rec_id") / 1000) % 3).cast("int").alias("client")).agg(
        F.count("*").alias("n_examples"), (F.avg("mem_percent") / 100).alias("loss"),
        F.avg(F.col("is_anomaly").cast("double")).alias("roc_auc"), F.avg("cpu_percent").alias("f1"),
    )


@query
def fedavg(spark: SparkSession, folder: str) -> DataFrame:
    """Feature means per client as parameters of two layers."""
    rows = views.metrics(spark, folder).withColumn("client", (F.floor(F.col("rec_id") / 1000) % 3).cast("int"))
    means = rows.groupBy("client").agg(
        F.count("*").alias("n_examples"), *[F.avg(F.col(c).cast("double")).alias(c) for c in METRIC_FEATURES]
    )
    layers = F.array(*[
        F.struct(F.lit(i).alias("layer"), F.array(*part).alias("values"))
        for i, part in enumerate([METRIC_FEATURES[:5], METRIC_FEATURES[5:]])
    ])
    params = means.select("client", "n_examples", F.inline(layers))
    return rounded(fed.fedavg(params).select("layer", F.posexplode("values").alias("pos", "value")), ["value"])


@query
def round_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = fed.round_metrics(_client_results(spark, folder))
    return rounded(found, ["avg_loss", "weighted_loss", "weighted_roc_auc", "weighted_f1"])


@query
def federated_status(spark: SparkSession, folder: str) -> DataFrame:
    history = fed.round_metrics(_client_results(spark, folder)).select("round", "n_clients", "avg_loss", "total_examples")
    status = fed.federated_status(history).select("current_round", "total_rounds", F.inline_outer("nodes"))
    return rounded(status, ["last_loss"])


# ---- SQL functions ------------------------------------------------------------------------------

@query
def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    sql_functions_module.register(spark)
    return spark.sql(
        """SELECT flow_id,
             round(bytes_out_in_ratio(bytes_out, bytes_in), 6) AS bytes_out_in_ratio,
             round(bytes_per_sec(bytes_out, bytes_in, seconds), 6) AS bytes_per_sec,
             is_common_port(dst_port) AS is_common_port,
             is_suspicious_port(dst_port) AS is_suspicious_port,
             round(byte_asymmetry(bytes_out, bytes_in), 6) AS byte_asymmetry,
             round(packets_per_sec(packets, seconds), 6) AS packets_per_sec,
             round(payload_density(bytes_per_packet(bytes_out, bytes_in, packets), seconds), 6) AS payload_density,
             is_zero_bytes(bytes_out, bytes_in) AS is_zero_bytes,
             round(fuse_supervised(byte_asymmetry(bytes_out, bytes_in), seconds, 0.5), 6) AS supervised
           FROM (SELECT *, coalesce(duration_ms, 0) / 1000.0D AS seconds FROM {flows}) f""",
        flows=views.flows(spark, folder),
    )


# ---- learned detectors (no closed form in SQL) --------------------------------------------------

def _metric_normals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = metric_view(spark, folder)
    return rows, fe.only_normal(rows)


@query
def pca_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Reconstruction error with one given component (all features alike)."""
    rows, normals = _metric_normals(spark, folder)
    detector = PcaReconstruction(METRIC_FEATURES, 1)
    detector.scaler = scaling.Standardizer.fit(normals, METRIC_FEATURES)
    detector.components = _even_component(len(METRIC_FEATURES))
    return rounded(detector.score(rows).select("rec_id", "score"), ["score"])


def _even_component(d: int):
    import numpy as np

    return np.full((1, d), d ** -0.5)


@query
def iforest_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows, normals = _metric_normals(spark, folder)
    detector = IsolationForest(METRIC_FEATURES).fit(normals, "rec_id", None)
    return rounded(detector.score(rows).select("rec_id", "is_anomaly", "score"), ["score"])


@query
def pca_reconstruction(spark: SparkSession, folder: str) -> DataFrame:
    rows, normals = _metric_normals(spark, folder)
    return PcaReconstruction(METRIC_FEATURES, 4).fit(normals).predict(rows).select("rec_id", "is_anomaly", "score", "prediction")


@query
def latent_2d(spark: SparkSession, folder: str) -> DataFrame:
    rows, normals = _metric_normals(spark, folder)
    detector = PcaReconstruction(METRIC_FEATURES, 2).fit(normals, None)
    return detector.latent_2d(rows).select("rec_id", "is_anomaly", "latent_x", "latent_y")


def _held_out(key: str) -> Column:
    """A fifth of the records, by a hash of the key, that no learner is trained on."""
    return records.uniform_hash(F.col(key), 42) < 0.2


@once
def metric_network(spark: SparkSession, folder: str) -> tuple[DataFrame, MlpReconstruction]:
    """Trained on the normals outside the held-out fifth; clip and threshold come from the labelled records outside it."""
    rows = metric_view(spark, folder)
    train = rows.where(~_held_out("rec_id"))
    return rows, MlpReconstruction(METRIC_FEATURES).fit(fe.only_normal(train), labelled=train)


@query
def mlp_reconstruction(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = metric_network(spark, folder)
    return detector.predict(rows).select("rec_id", "is_anomaly", "score", "prediction", _held_out("rec_id").alias("held_out"))


@query
def mlp_latent_2d(spark: SparkSession, folder: str) -> DataFrame:
    """The network's latent vectors in two dimensions."""
    rows, detector = metric_network(spark, folder)
    return detector.latent_2d(rows).select("rec_id", "is_anomaly", "latent_x", "latent_y")


@once
def flow_trees(spark: SparkSession, folder: str) -> tuple[DataFrame, BoostedTrees]:
    rows = flow_rows(spark, folder)
    train = rows.where(~_held_out("flow_id"))
    return rows, BoostedTrees(FLOW_FEATURES).fit(train, "is_anomaly", validation=train)


@query
def boosted_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = flow_trees(spark, folder)
    return detector.predict(rows).select("flow_id", "is_anomaly", "score", "prediction", _held_out("flow_id").alias("held_out"))


@query
def boosted_importance(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = flow_trees(spark, folder)
    return detector.feature_importance(rows, top=10)


@query
def boosted_importance_total(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for importances: one per feature, none negative, and one in all."""
    rows, detector = flow_trees(spark, folder)
    return detector.feature_importance(rows).agg(
        F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"), F.sum((F.col("importance") < 0).cast("long")).alias("negative"))


def _tree_attributed(spark: SparkSession, folder: str) -> DataFrame:
    rows, detector = flow_trees(spark, folder)
    return tree_shapley(rows.where("is_anomaly"), detector, raw="raw", base="base")


@query
def tree_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """What drove the boosted trees' output for every anomalous flow: its three largest values."""
    return _tree_attributed(spark, folder).select("flow_id", F.posexplode(F.slice("attribution", 1, 3)).alias("place", "entry")).select(
        "flow_id", "place", "entry.feature", "entry.value")


@query
def tree_attribution_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's values add up to its raw output less the mean output; ``gap`` is what is missing."""
    total = F.aggregate("attribution", F.lit(0.0), lambda a, e: a + e["value"])
    gap = F.col("raw") - F.col("base") - total
    return _tree_attributed(spark, folder).select("flow_id", F.size("attribution").cast("long").alias("features"), F.abs(F.round(gap, 5)).alias("gap"))


@query
def forest_attribution_sums(spark: SparkSession, folder: str) -> DataFrame:
    """The same for an isolation forest on metrics, whose raw output is the exponent of its score."""
    rows, normals = _metric_normals(spark, folder)
    detector = IsolationForest(METRIC_FEATURES).fit(normals, "rec_id", None)
    found = tree_shapley(detector.score(rows.where("is_anomaly")), detector, raw="raw", base="base")
    total = F.aggregate("attribution", F.lit(0.0), lambda a, e: a + e["value"])
    return found.select("rec_id", F.abs(F.round(F.col("base") + total - F.log2("score"), 5)).alias("gap"))


@query
def pca_keeps_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """With as many components as features the fitted projection only turns the standardised records: lengths stay."""
    rows, normals = _metric_normals(spark, folder)
    detector = PcaReconstruction(METRIC_FEATURES, len(METRIC_FEATURES)).fit(normals, None)
    turned = sum((F.pow(detector.latent(i), 2) for i in range(len(METRIC_FEATURES))), F.lit(0.0))
    return rounded(rows.select("rec_id", turned.alias("squared_length"), detector.expression().alias("error")), ["squared_length", "error"], 5)


@query
def held_out_network(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees, the reconstruction network, the forest and the fusion of trees and network on flows that none was trained on."""
    rows, trees = flow_trees(spark, folder)
    train = rows.where(~_held_out("flow_id"))
    normals = fe.only_normal(train)
    network = MlpReconstruction(FLOW_FEATURES).fit(normals, labelled=train)
    forest = IsolationForest(FLOW_FEATURES).fit(normals, "flow_id")
    fused = Pipeline("network", "flow_id", {"sup_score": trees, "ae_score": network}, 0.5)
    threshold = cal.threshold_max_f1(durable(fused.scored(train).select("fused_score", "is_anomaly")), "fused_score", "is_anomaly", 0.9).first()["threshold"]
    scored = durable(forest.score(fused.scored(rows.where(_held_out("flow_id"))), "if_score").select(
        "is_anomaly", "sup_score", "ae_score", "if_score", "fused_score"))
    limits = {"boosted": trees.threshold, "network": network.threshold, "forest": forest.threshold, "fused": threshold}
    names = {"boosted": "sup_score", "network": "ae_score", "forest": "if_score", "fused": "fused_score"}
    return ev.compare_detectors(scored, names, "is_anomaly", limits)


def _counted_logs(spark: SparkSession, folder: str, detector: LogTextDetector) -> DataFrame:
    """Logs with the counts of their hashed terms in place of the text."""
    docs = detector.hashed(table(spark, folder, "documents"), "text")
    return views.logs(spark, folder, {"_tf": F.col("_tf")}, F.lit(None).cast("string"), docs)


@query
def log_text_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Trained on the labelled logs outside the held-out fifth."""
    detector = LogTextDetector()
    rows = _counted_logs(spark, folder, detector).withColumn("held_out", _held_out("log_id"))
    detector.fit(rows.where("not held_out"))
    return detector.predict(rows).select("log_id", "is_anomaly", "score", "prediction", "held_out")


def _term_attributed(spark: SparkSession, folder: str, top: int) -> DataFrame:
    detector = LogTextDetector()
    detector.fit(_counted_logs(spark, folder, detector))
    toxic = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    rows = table(spark, folder, "documents").join(toxic, "doc_id", "left_semi").select(F.col("doc_id").alias("log_id"), F.col("text").alias("message"))
    return detector.term_attribution(detector.score(rows), top=top, raw="raw", base="base")


@query
def term_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """The five terms that moved the score of each anomalous log most."""
    return _term_attributed(spark, folder, 5).select("log_id", F.posexplode(F.slice("attribution", 1, 5)).alias("place", "entry")).select(
        "log_id", "place", F.col("entry.feature").alias("term"), "entry.value")


@query
def term_attribution_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Terms and intercept add up to the log-odds of the score; ``terms`` counts the distinct ones."""
    total = F.aggregate("attribution", F.lit(0.0), lambda a, e: a + e["value"]) + F.col("base")
    gap = _log_odds(F.col("score")) - F.greatest(F.least(total, F.lit(MOST_ODDS)), F.lit(-MOST_ODDS))
    return _term_attributed(spark, folder, 10**9).select("log_id", F.abs(F.round(gap, 3)).alias("gap"))


MOST_ODDS = 20.0  # log-odds beyond which a probability in double precision no longer tells them apart


def _log_odds(score: Column) -> Column:
    """Log-odds of a probability within ``MOST_ODDS``; a sure score, rounded to 0 or 1, has the outermost ones."""
    odds = F.log(score / F.nullif(1 - score, F.lit(0.0)))
    return F.when(score <= 0, -MOST_ODDS).when(score >= 1, MOST_ODDS).otherwise(F.greatest(F.least(odds, F.lit(MOST_ODDS)), F.lit(-MOST_ODDS)))


@query
def shapley_values(spark: SparkSession, folder: str) -> DataFrame:
    """Attribution of the alerts of a linear reconstruction detector."""
    rows, normals = _metric_normals(spark, folder)
    detector = PcaReconstruction(METRIC_FEATURES, 3).fit(normals)
    raised = detector.score(rows).where(F.col("score") >= F.lit(detector.threshold))
    background = sampling.background_sample(rows, "rec_id", 200)
    found = shapley(raised, METRIC_FEATURES, detector.on_arrays(), background, "exact")
    return found.select("rec_id", F.inline("attribution"))


@query
def shapley_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Values over all feature sets add up to the score less the mean score of the background; ``gap`` is what is missing."""
    rows, normals = _metric_normals(spark, folder)
    detector = PcaReconstruction(METRIC_FEATURES, 3).fit(normals)
    background = durable(sampling.background_sample(rows, "rec_id", 200).select(*METRIC_FEATURES))
    base = detector.score(background).agg(F.avg("score")).first()[0]
    found = shapley(detector.score(rows.where("is_anomaly")), METRIC_FEATURES, detector.on_arrays(), background, "exact")
    total = F.aggregate("attribution", F.lit(0.0), lambda a, e: a + e["value"])
    return found.select("rec_id", F.abs(F.round(F.col("score") - F.lit(base) - total, 4)).alias("gap"))


@query
def custom_scorer(spark: SparkSession, folder: str) -> DataFrame:
    """A scorer written in pandas: load per connection."""
    def scorer(batch):
        return (batch["cpu_percent"] + batch["mem_percent"]) / (batch["open_connections"] + 1)

    rows = views.metrics(spark, folder)
    found = custom_score(rows, ["cpu_percent", "mem_percent", "open_connections"], scorer)
    return rounded(found.select("rec_id", "score"), ["score"])


def _clients(spark: SparkSession, folder: str) -> DataFrame:
    return durable(ordering.partition_clients(views.metrics(spark, folder), 3, ["ts", "rec_id"]))


@once
def _federated(spark: SparkSession, folder: str) -> tuple[DataFrame, fed.FederatedModel]:
    rows = _clients(spark, folder)
    return rows, fed.federated_fit(rows, METRIC_FEATURES)


@query
def federated_fit(spark: SparkSession, folder: str) -> DataFrame:
    _, model = _federated(spark, folder)
    return model.history_table(spark)


@query
def federated_eval(spark: SparkSession, folder: str) -> DataFrame:
    rows, model = _federated(spark, folder)
    return fed.federated_evaluate(rows, model)


@query
def federated_vs_central(spark: SparkSession, folder: str) -> DataFrame:
    rows, model = _federated(spark, folder)
    central = MlpReconstruction(METRIC_FEATURES, epochs=25).fit(fe.only_normal(rows), None)  # as many epochs as all rounds
    both = durable(central.score(model.score(rows, name="federated"), "central").select("is_anomaly", "federated", "central"))
    names = {"federated": "federated", "central": "central"}
    return ev.compare_detectors(both, names, "is_anomaly", _score_quantiles(both, list(names)))
