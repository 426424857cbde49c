"""Mean squared z-score: a closed-form detector that is one column expression."""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.detectors.base import Detector
from tidewatch.operators.scaling import Standardizer
from tidewatch.schemas import FIT_PERCENTILE


class ZScoreDetector(Detector):
    kind = "zscore"

    def __init__(self, features: list[str], scaler: Standardizer | None = None):
        super().__init__(features)
        self.scaler = scaler

    def fit(self, normals: DataFrame, fraction: float | None = FIT_PERCENTILE) -> ZScoreDetector:
        """Learn the scaling; with ``fraction`` also the threshold. Both are literals from here on."""
        self.scaler = Standardizer.fit(normals, self.features)
        if fraction is not None:
            self.fit_bounds(normals, fraction)
        return self

    def expression(self) -> Column:
        total = None
        for c in self.features:
            square = self.scaler.squared(c)
            total = square if total is None else total + square
        return total * F.lit(1.0 / len(self.features))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, self.expression())

    def on_arrays(self):
        mean, std = np.array(self.scaler.mean), np.array(self.scaler.std)
        return lambda x: (((x - mean) / std) ** 2).mean(axis=1)

    def meta(self) -> dict:
        return super().meta() | {"scaler": asdict(self.scaler)}
