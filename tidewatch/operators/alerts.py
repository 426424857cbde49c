"""Decisions, alerts, and the queries over stored alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import records
from tidewatch.operators.explain import alert_narrative, top_features
from tidewatch.operators.knowledge import attach_attack_knowledge
from tidewatch.schemas import ALERT_SCHEMA, MODALITIES, SEVERITIES

DETAIL_COLUMNS = ALERT_SCHEMA.names
BASELINE_SCORE = 0.08  # fixed value: drawn for records that raised no alert


def decide(
    df: DataFrame, score: str, threshold: float, mode: str = "model", label: str = "is_anomaly", name: str = "is_alert"
) -> DataFrame:
    """True where a record raises an alert.

    ``model``: the score reaches the threshold. ``label_first``: a label on the record wins, and only
    unlabelled records are decided by score.
    """
    by_score = F.coalesce(F.col(score) >= F.lit(float(threshold)), F.lit(False))
    if mode == "model":
        return df.withColumn(name, by_score)
    if mode == "label_first":
        known = F.col(label).cast("boolean") if label in df.columns else F.lit(None).cast("boolean")
        return df.withColumn(name, F.coalesce(known, by_score))
    raise ValueError(f"unknown decision mode: {mode}")


def alert_id(modality: str, key: Column) -> Column:
    """The same record always gets the same id, so a replay overwrites rather than adds."""
    return F.md5(F.concat_ws("|", F.lit(modality), key.cast("string")))


def build_alerts(
    df: DataFrame,
    modality: str,
    key: str,
    score: str = "fused_score",
    features: Sequence[str] = (),
    attribution: str | None = None,
    time: str = "ts",
) -> DataFrame:
    """Turn records already decided to be anomalous into alerts.

    With an attribution column the top features are its first three, else the first three of
    ``features``, else the first three fields of the record. The join to the knowledge table is the only
    one.
    """
    if modality not in MODALITIES:
        raise ValueError(f"unknown modality: {modality}")
    record = [c for c in df.columns if c not in (attribution, score)]
    shown = list(features) or record[:3]
    if attribution:
        top, parts = top_features(F.col(attribution), 3), F.col(attribution)
    else:
        shown = shown[:3]
        top = F.array(*[F.lit(c) for c in shown])
        parts = F.lit(None).cast(ALERT_SCHEMA["shap_attribution"].dataType)
    values = F.create_map(*[x for c in shown for x in (F.lit(c), F.col(c).cast("string"))])
    kind = F.coalesce("anomaly_type", F.lit("unknown")) if "anomaly_type" in record else F.lit("unknown")
    staged = df.select(
        alert_id(modality, F.col(key)).alias("id"),
        F.col(time).alias("timestamp"),
        records.origin(record).alias("source"),
        F.lit(modality).alias("modality"),
        kind.alias("anomaly_type"),
        F.col(score).alias("_score"),
        top.alias("top_features"),
        values.alias("_values"),
        parts.alias("shap_attribution"),
        F.to_json(F.struct(*record)).alias("raw_record"),
    )
    return attach_attack_knowledge(staged, "anomaly_type").select(
        "id", "timestamp", "source", "modality", "anomaly_type",
        F.round("_score", 4).alias("fused_score"),
        "severity",
        F.lit(False).alias("is_acknowledged"),
        F.col("tactic").alias("mitre_tactic"), F.col("tactic_id").alias("mitre_tactic_id"),
        F.col("technique").alias("mitre_technique"), F.col("technique_id").alias("mitre_technique_id"),
        "description", "recommended_action", "top_features",
        F.map_filter("_values", lambda k, _: F.array_contains("top_features", k)).alias("feature_values"),
        "shap_attribution",
        alert_narrative(F.col("_score")).alias("narrative"),
        "raw_record",
    )


def union_modalities(*alerts: DataFrame) -> DataFrame:
    """Alerts of all modalities in one table."""
    out = alerts[0]
    for more in alerts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def dedupe_alerts(alerts: DataFrame, order: str = "timestamp") -> DataFrame:
    """Last write per id; of equal times the one whose fields as text are last.

    Kept as an aggregation, so many copies of one id are reduced inside each task.
    """
    whole = F.struct(*alerts.columns)
    return alerts.groupBy("id").agg(F.max_by(whole, F.struct(F.col(order), F.to_json(whole))).alias("a")).select("a.*")


def check_severity(severity: str | None) -> None:
    if severity is not None and severity not in SEVERITIES:
        raise ValueError(f"severity must be one of {SEVERITIES}, got {severity}")


def alerts_by_severity(alerts: DataFrame, severity: str | None) -> DataFrame:
    check_severity(severity)
    return alerts if severity is None else alerts.where(F.col("severity") == severity)


def latest_alerts(alerts: DataFrame, limit: int = 100, severity: str | None = None) -> DataFrame:
    """Newest alerts first; equal times are ordered by id."""
    if not 0 < limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    return _newest(alerts_by_severity(alerts, severity), limit)


def _newest(df: DataFrame, n: int, time: str = "timestamp", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def get_alert(alerts: DataFrame, alert: str) -> DataFrame:
    """One alert with the fields needed to explain it; empty when there is none."""
    return alerts.where(F.col("id") == alert).select(*DETAIL_COLUMNS)


def count_by_severity(alerts: DataFrame, last: int | None = None) -> DataFrame:
    """Always four rows; a severity without alerts counts 0. ``last`` limits it to the newest alerts."""
    rows = alerts if last is None else _newest(alerts, last)
    counts = rows.groupBy("severity").agg(F.count("*").alias("n"))
    every = alerts.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def count_by_tactic(alerts: DataFrame) -> DataFrame:
    tactic = F.coalesce("mitre_tactic", F.lit("Unknown")).alias("tactic")
    return alerts.groupBy(tactic).agg(F.count("*").alias("n"))


def latest_acks(acks: DataFrame) -> DataFrame:
    """The newest acknowledgement per alert."""
    newest = F.max(F.struct("acknowledged_at", "acknowledged_by", "note"))
    return acks.groupBy("alert_id").agg(newest.alias("a")).select("alert_id", "a.*")


def acknowledged_alerts(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with their newest acknowledgement, if any."""
    last = latest_acks(acks).withColumnRenamed("alert_id", "_acked")
    return (
        alerts.drop("is_acknowledged")
        .join(last, F.col("id") == F.col("_acked"), "left")
        .withColumn("is_acknowledged", F.col("_acked").isNotNull())
        .drop("_acked")
    )


def alerts_without_ack(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    acked = acks.select("alert_id").distinct()  # many acknowledgements of one alert become one row per task
    return alerts.join(acked, F.col("id") == F.col("alert_id"), "left_anti")


def acks_without_alert(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Acknowledgements of alerts that do not exist.

    The ids are compared once each; their rows then follow by a join that Spark can split, as its right side is unique.
    """
    orphans = acks.select("alert_id").distinct().join(alerts.select("id"), F.col("id") == F.col("alert_id"), "left_anti")
    return acks.join(orphans.withColumnRenamed("alert_id", "_orphan"), F.col("alert_id").eqNullSafe(F.col("_orphan"))).drop("_orphan")


def stream_stats(df: DataFrame, flag: str = "is_alert", time: str = "ts") -> DataFrame:
    """Processed records, anomalies, rate, records per second and first time seen."""
    return df.agg(
        F.count("*").alias("total_records_processed"),
        F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("total_anomalies_detected"),
        F.min(time).alias("active_since"),
        F.max(time).alias("_last"),
    ).select(
        "total_records_processed", "total_anomalies_detected",
        F.round(F.col("total_anomalies_detected") / F.greatest("total_records_processed", F.lit(1).cast("long")), 4)
        .alias("anomaly_rate"),
        F.round(
            F.col("total_records_processed")
            / F.greatest(
                (F.unix_micros(F.col("_last").cast("timestamp")) - F.unix_micros(F.col("active_since").cast("timestamp")))
                / 1e6,
                F.lit(1.0),
            ),
            2,
        ).alias("records_per_second"),
        "active_since",
    )


def dashboard_stats(
    df: DataFrame, n: int = 200, flag: str = "is_alert", severity: str = "severity", time: str = "ts", key: str = "id"
) -> DataFrame:
    """Totals over the newest ``n`` records."""
    one = F.lit(1).cast("long")
    return _newest(df.select(time, key, flag, severity), n, time, key).agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("anomalies"),
        F.coalesce(F.sum((F.col(flag) & (F.col(severity) == "critical")).cast("long")), F.lit(0)).alias("critical"),
    ).withColumn("rate_pct", F.round(100.0 * F.col("anomalies") / F.greatest("total", one), 1))


def waveform(
    df: DataFrame, n: int = 80, score: str = "fused_score", flag: str = "is_alert", time: str = "ts", key: str = "id"
) -> DataFrame:
    """The newest ``n`` points, oldest first; records without an alert are drawn at a low constant."""
    value = F.coalesce(F.when(F.col(flag), F.col(score)), F.lit(BASELINE_SCORE))
    return _newest(df.select(time, key, value.alias("value")), n, time, key).orderBy(time, key)


def feed_view(df: DataFrame, flag: str = "is_alert") -> DataFrame:
    """What a feed shows per record: type, source and a title."""
    kind = F.coalesce("anomaly_type", F.lit("unknown"))
    message = F.substring("message", 1, 60) if "message" in df.columns else F.lit(None).cast("string")
    plain = F.coalesce(F.when(F.length(message) > 0, message), F.lit("normal activity"))
    return df.withColumns({
        "type": F.when(F.col(flag), "alert").otherwise("record"),
        "origin": records.origin(df.columns),
        "title": F.when(F.col(flag), F.regexp_replace(kind, "_", " ")).otherwise(plain),
    })


def windowed_stats(
    df: DataFrame, width: str = "1 hour", time: str = "ts", flag: str = "is_alert", late: str | None = None
) -> DataFrame:
    """Counts per event-time window and modality; batch or streaming.

    On a stream give ``late``, the lateness allowed, so that old windows leave the state.
    """
    rows = df.withWatermark(time, late) if late else df
    return (
        rows.groupBy(F.window(time, width).alias("w"), "modality")
        .agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("anomalies"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "modality", "n", "anomalies",
            F.round(F.col("anomalies") / F.col("n"), 4).alias("anomaly_rate"),
            F.round(
                F.col("n") / ((F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6), 6
            ).alias("records_per_second"),
        )
    )
