"""Data profiling: summaries, value counts, class statistics, histograms, correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import exact_quantiles
from tidewatch.schemas import PERCENTILES


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share per value. The total is a scalar summed over the counts."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), column)


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def dataset_summary(frames: Mapping[str, DataFrame], label: str = "is_anomaly") -> DataFrame:
    """Records, anomalies and rate in percent per modality, and over all of them (modality 'total')."""
    parts = [
        df.select(F.lit(modality).alias("modality"), F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("y"))
        for modality, df in frames.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return (
        rows.rollup("modality")
        .agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("anomalies"))
        .select(
            F.coalesce("modality", F.lit("total")).alias("modality"), "n", "anomalies",
            F.round(100.0 * F.col("anomalies") / F.col("n"), 2).alias("rate_pct"),
        )
    )


def class_means(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One row per feature: its mean over normals and over anomalies, from one aggregation."""
    y = F.col(label).cast("int")
    means = df.agg(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(F.when(y == 0, F.col(c).cast("double"))).alias("normal_mean"),
            F.avg(F.when(y == 1, F.col(c).cast("double"))).alias("anomaly_mean"),
        ).alias(c)
        for c in columns
    ])
    return means.select(F.inline(F.array(*columns)))


def class_ranges(df: DataFrame, column: str, label: str) -> DataFrame:
    """Range of a score per class, and whether the two ranges overlap."""
    y, value = F.col(label).cast("int"), F.col(column).cast("double")
    return df.agg(
        F.min(F.when(y == 0, value)).alias("normal_min"), F.max(F.when(y == 0, value)).alias("normal_max"),
        F.min(F.when(y == 1, value)).alias("anomaly_min"), F.max(F.when(y == 1, value)).alias("anomaly_max"),
    ).withColumn(
        "overlap",
        (F.col("normal_max") >= F.col("anomaly_min")) & (F.col("anomaly_max") >= F.col("normal_min")),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs in long form, each pair once, from one aggregation."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(*[
        F.struct(
            F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"),
        ).alias(f"c{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    return wide.select(F.inline(F.array(*wide.columns)))


def score_percentiles(df: DataFrame, score: str, fractions: Sequence[float] = tuple(PERCENTILES)) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    found = exact_quantiles(df, score, fractions).get((), {})
    rows = [(float(f), found.get(f)) for f in fractions]
    return df.sparkSession.createDataFrame(rows, "fraction double, value double")


def score_stats(df: DataFrame, score: str, threshold: float) -> DataFrame:
    value = F.col(score)
    return df.agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.avg((value >= F.lit(float(threshold))).cast("double")).alias("share_above"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width bins over the range of each class; the last bin includes its upper end.

    ``by`` is a class column; the range of each class becomes a literal.
    """
    keys = [by] if by else []
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("value"))
    ranges = {
        tuple(r[k] for k in keys): (r["low"], r["high"])
        for r in rows.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    }  # one row per class
    slot, start = F.lit(None).cast("long"), F.lit(None).cast("double")
    for key, (low, high) in ranges.items():
        width = (high - low) / bins or 1.0
        here = F.least(F.floor((F.col("value") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long")
        if by:
            same = F.col(by).eqNullSafe(F.lit(key[0]))
            slot = F.when(same, here).otherwise(slot)
            start = F.when(same, F.lit(low) + here * F.lit(width)).otherwise(start)
        else:
            slot, start = here, F.lit(low) + here * F.lit(width)
    return (
        rows.withColumns({"bin": slot, "bin_start": start})
        .groupBy(*keys, "bin", "bin_start")
        .agg(F.count("*").alias("n"))
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weights of the two classes: 1 for normals, normals per anomaly for anomalies."""
    y = F.col(label).cast("int")
    return df.agg(
        F.coalesce(F.sum(F.when(y == 0, 1)), F.lit(0)).alias("n_normal"),
        F.coalesce(F.sum(F.when(y == 1, 1)), F.lit(0)).alias("n_anomaly"),
    ).withColumns({
        "normal_weight": F.lit(1.0),
        "anomaly_weight": F.round(F.col("n_normal") / F.greatest(F.col("n_anomaly"), F.lit(1).cast("long")), 2),
    })
