"""Attributions, explanations and narratives.

An attribution is ``array<struct<feature, value>>`` sorted by absolute value, because its order matters
and a map has none. Sorting and cutting happen inside the row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.scaling import Standardizer
from tidewatch.schemas import ALERT_SCHEMA


def sorted_attribution(values: Mapping[str, Column]) -> Column:
    """Array of (feature, value), largest absolute value first, equal ones in feature order."""
    entries = F.array(*[
        F.struct(
            (-F.abs(value)).alias("rank"), F.lit(i).alias("place"),
            F.lit(name).alias("feature"), value.alias("value"),
        )
        for i, (name, value) in enumerate(values.items())
    ])
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value")))


def additive_attribution(
    df: DataFrame, scaler: Standardizer, background: Mapping[str, float] | None = None, name: str = "attribution"
) -> DataFrame:
    """Exact Shapley values of the mean-squared-z score: each feature's share minus its background mean.

    With the training records as background the mean of z squared is 1 (0 for a constant feature).
    """
    d = len(scaler.features)
    shares = {}
    for i, c in enumerate(scaler.features):
        base = (background or {}).get(c, scaler.background_share(i))
        shares[c] = F.round(F.pow(scaler.z(c), 2) / d - F.lit(base), 6)
    return df.withColumn(name, sorted_attribution(shares))


def top_features(attribution: Column, n: int = 3) -> Column:
    return F.transform(F.slice(attribution, 1, n), lambda e: e["feature"])


def top_heuristic(features: Sequence[str], n: int = 3) -> Column:
    """Features by absolute raw value, for records without an attribution."""
    return top_features(sorted_attribution({c: F.col(c).cast("double") for c in features}), n)


def attribution_bars(df: DataFrame, attribution: str = "attribution", k: int = 8, keep: Sequence[str] = ()) -> DataFrame:
    """Bars of a record: its largest non-zero attributions, with length relative to the longest."""
    shown = F.slice(F.filter(F.col(attribution), lambda e: e["value"] != 0), 1, k)
    longest = F.abs(F.get(shown, 0)["value"])
    bars = F.transform(
        shown,
        lambda e: F.struct(
            e["feature"].alias("feature"), e["value"].alias("value"), (F.abs(e["value"]) / longest * 100).alias("pct")
        ),
    )
    return df.select(*keep, F.inline(bars))


def global_importance(df: DataFrame, attribution: str = "attribution") -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return (
        df.select(F.inline(attribution))
        .groupBy("feature")
        .agg(F.avg(F.abs("value")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def most_anomalous(df: DataFrame, score: str, key: str, label: str = "is_anomaly") -> DataFrame:
    """The positive record with the highest score (lowest key on a tie)."""
    return df.where(F.col(label).cast("int") == 1).orderBy(F.desc(score), key).limit(1)


#: What an explanation says where a record has no value: by field of the alert record, the column and its default.
_EXPLAINED = {
    "source": (None, "unknown"), "anomaly_type": ("anomaly_type", "unknown"), "severity": ("severity", "unknown"),
    **{f"mitre_{c}": (c, "Unknown") for c in ("tactic", "technique")},
    **{f"mitre_{c}": (c, "N/A") for c in ("tactic_id", "technique_id")},
    **{c: (c, "") for c in ("description", "recommended_action")},
}


def build_explanation(df: DataFrame, features: Sequence[str], score: str = "fused_score", attribution: str = "attribution",
                      time: str = "ts", origin: str = "source") -> DataFrame:
    """Add the fields of the alert record that explain it; those without a value get the defaults of ``_EXPLAINED``."""
    top = top_features(F.col(attribution), 3)
    shown = F.create_map(*[x for c in features for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("N/A")))])
    found = {
        "timestamp": F.col(time), "fused_score": F.round(score, 4), "top_features": top,
        "feature_values": F.map_filter(shown, lambda k, _: F.array_contains(top, k)),
    }
    for field in ALERT_SCHEMA.names:
        if field in _EXPLAINED:
            column, default = _EXPLAINED[field]
            column = column or origin
            found[field] = F.coalesce(F.col(column), F.lit(default)) if column in df.columns else F.lit(default)
    return df.withColumns(found)


def explanation_narrative(df: DataFrame, name: str = "narrative") -> DataFrame:
    """One line of facts for an explanation: when and where, how strong, what drove it, what it may be, what to do."""
    drivers = F.array_join(
        F.transform("top_features", lambda f: F.concat(f, F.lit("="), F.try_element_at("feature_values", f))), ", "
    )
    return df.withColumn(name, F.concat_ws(
        " | ",
        F.concat(F.col("timestamp").cast("string"), F.lit(" "), F.col("source")),
        F.concat(F.lit("severity "), F.col("severity"), F.lit(", score "), _three_places(F.col("fused_score"))),
        F.concat(F.lit("driven by "), drivers),
        _technique("mitre_tactic", "mitre_tactic_id", "mitre_technique", "mitre_technique_id"),
        "description",
        F.concat(F.lit("next: "), F.col("recommended_action")),
    ))


def alert_narrative(score: Column) -> Column:
    """One line of facts for an alert, from its type, modality and knowledge columns."""
    return F.concat_ws(
        " | ",
        F.concat("modality", F.lit(" "), "anomaly_type"),
        F.concat(F.lit("severity "), F.col("severity"), F.lit(", score "), _three_places(score)),
        _technique("tactic", "tactic_id", "technique", "technique_id"),
        "description",
        F.concat(F.lit("next: "), F.col("recommended_action")),
    )


def _technique(tactic: str, tactic_id: str, technique: str, technique_id: str) -> Column:
    return F.concat(technique_id, F.lit(" "), technique, F.lit(" < "), tactic_id, F.lit(" "), tactic)


def _three_places(score: Column) -> Column:
    return F.format_string("%.3f", score)
