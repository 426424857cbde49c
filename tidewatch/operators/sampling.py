"""Repeatable splits and samples: chosen by a hash of the record key, not by position or layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.records import uniform_hash
from tidewatch.operators.features import only_normal
from tidewatch.operators.ordering import exact_quantiles


def stratified_split(
    df: DataFrame, key: str, label: str, test: float, seed: int = 42, name: str = "split", validation: float = 0.0
) -> DataFrame:
    """Tag each row test, validation or train so that each class keeps its share in every part.

    The cut per class is the exact quantile of the key hash, so part sizes are right to the row
    (up to rounding) without sorting the table.
    """
    hashed = df.withColumn("_u", uniform_hash(F.col(key), seed))
    fractions = [test, test + validation] if validation else [test]
    cuts = exact_quantiles(hashed.select(F.col(label).cast("string").alias("_class"), "_u"), "_u", fractions, ["_class"])
    part: Column = F.lit(None).cast("string")
    for (cls,), cut in cuts.items():
        tag = F.when(F.col("_u") < cut[fractions[0]], "test")
        if validation:
            tag = tag.when(F.col("_u") < cut[fractions[1]], "validation")
        same = F.col(label).cast("string").eqNullSafe(F.lit(cls))
        part = F.when(same, tag.otherwise("train")).otherwise(part)
    return hashed.withColumn(name, part).drop("_u")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order (a top-n, so no full sort)."""
    return df.orderBy(uniform_hash(F.col(key), seed), key).limit(n)


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def sample_per_label(
    df: DataFrame, key: str, label: str, labels: Sequence, n: int, seed: int = 42, text: str = "message", width: int = 80
) -> DataFrame:
    """A few rows of each listed label with their text shortened for display: one top-n per label."""
    parts = [
        sample_rows(df.where(F.col(label) == F.lit(value)), key, n, seed)
        .select(key, label, F.substring(text, 1, width).alias(text))
        for value in labels
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def background_sample(
    df: DataFrame, key: str, n: int = 200, seed: int = 42, label: str = "is_anomaly", at_least: int = 10
) -> DataFrame:
    """At most ``n`` normal records to compare explained records with; too few is an error."""
    chosen = sample_rows(only_normal(df, label), key, n, seed)
    found = chosen.limit(at_least).count()
    if found < at_least:
        raise ValueError(f"background needs at least {at_least} normal records, found {found}")
    return chosen
