"""Standardisation and min-max scaling learned in one aggregation and applied as literals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.features import require_columns


@dataclass
class Standardizer:
    """Mean and population standard deviation per feature; a constant feature is divided by 1."""

    features: list[str]
    mean: list[float]
    std: list[float]
    varies: list[bool]
    rows: int = 0

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> Standardizer:
        require_columns(df, features)
        value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
        row = df.agg(
            F.count("*").alias("rows"),
            *[F.avg(value[c]).alias(f"avg_{c}") for c in features],
            *[F.stddev_pop(value[c]).alias(f"std_{c}") for c in features],
        ).first()  # two numbers per feature
        if not row["rows"]:
            raise ValueError("cannot fit on an empty table")
        return cls(
            list(features),
            [row[f"avg_{c}"] for c in features],
            [row[f"std_{c}"] or 1.0 for c in features],
            [bool(row[f"std_{c}"]) for c in features],
            row["rows"],
        )

    def z(self, feature: str) -> Column:
        i = self.features.index(feature)
        value = F.coalesce(F.col(feature).cast("double"), F.lit(0.0))
        return (value - F.lit(self.mean[i])) * F.lit(1.0 / self.std[i])

    def squared(self, feature: str) -> Column:
        """z squared; never null, so a null test on a score of these is folded away."""
        return self.z(feature) * self.z(feature)

    def background_share(self, i: int) -> float:
        """Mean of z squared over the training records, divided by the number of features."""
        return (1.0 if self.varies[i] else 0.0) / len(self.features)

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the features by their standardised values."""
        require_columns(df, self.features)
        return df.withColumns({c: self.z(c) for c in self.features})

    def vector(self) -> Column:
        """All standardised features as one array column."""
        return F.array(*[self.z(c) for c in self.features])


def minmax_normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale each score to [0, 1] over the whole table.

    One row is left as it is, and a constant column becomes 0. Nulls stay null.
    """
    row = df.agg(
        *[F.min(c).alias(f"min_{c}") for c in columns],
        *[F.max(c).alias(f"max_{c}") for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in columns],
    ).first()  # three numbers per column
    scaled = {}
    for c in columns:
        low, high, n = row[f"min_{c}"], row[f"max_{c}"], row[f"n_{c}"]
        if n <= 1:
            continue
        if high - low < 1e-8:
            scaled[c] = F.when(F.col(c).isNotNull(), F.lit(0.0))
        else:
            scaled[c] = (F.col(c) - F.lit(low)) / F.lit(high - low)
    return df.withColumns(scaled) if scaled else df
