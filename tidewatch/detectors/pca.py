"""Reconstruction error of a linear autoencoder.

Trained with squared error, a linear autoencoder spans the leading principal components, so these are
computed directly: one aggregation gives the correlation matrix, its eigenvectors are found for the
d x d matrix, and the error is a column expression.
"""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.detectors.base import Detector
from tidewatch.functions.fusion import clip
from tidewatch.operators.scaling import Standardizer
from tidewatch.schemas import FIT_PERCENTILE


class PcaReconstruction(Detector):
    kind = "pca"

    def __init__(self, features: list[str], k: int = 4):
        super().__init__(features)
        self.k = k
        self.scaler: Standardizer | None = None
        self.components: np.ndarray | None = None

    def fit(self, normals: DataFrame, fraction: float | None = FIT_PERCENTILE, labelled: DataFrame | None = None,
            label: str = "is_anomaly", min_recall: float = 0.90) -> PcaReconstruction:
        """Learn from normal records; with labelled ones clip and threshold are learned from their scores."""
        self.scaler = Standardizer.fit(normals, self.features)
        d = len(self.features)
        z = [self.scaler.z(c) for c in self.features]
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = normals.agg(*[F.avg(z[i] * z[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()  # d(d+1)/2 numbers
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
        _, vectors = np.linalg.eigh(cov)
        leading = vectors[:, ::-1][:, : self.k].T
        signs = np.sign(leading[np.arange(len(leading)), np.abs(leading).argmax(axis=1)])
        self.components = leading * signs[:, None]
        if labelled is not None:
            self.calibrate(labelled, label, min_recall)
        elif fraction is not None:
            self.fit_bounds(normals, fraction)
        return self

    def latent(self, i: int) -> Column:
        """Coordinate of a record along one component."""
        return sum(
            (F.lit(float(w)) * self.scaler.z(c) for w, c in zip(self.components[i], self.features)), F.lit(0.0)
        )

    def expression(self) -> Column:
        rest = np.eye(len(self.features)) - self.components.T @ self.components
        z = [self.scaler.z(c) for c in self.features]
        error = F.lit(0.0)
        for weights in rest:
            error = error + F.pow(sum((F.lit(float(w)) * v for w, v in zip(weights, z)), F.lit(0.0)), 2)
        error = error / len(self.features)
        return error if self.score_clip is None else clip(error, 0, self.score_clip)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, self.expression())

    def latent_2d(self, df: DataFrame) -> DataFrame:
        """The two leading latent coordinates, as ``latent_x`` and ``latent_y``."""
        return df.withColumns({"latent_x": self.latent(0), "latent_y": self.latent(1)})

    def on_arrays(self):
        mean, std = np.array(self.scaler.mean), np.array(self.scaler.std)
        rest = np.eye(len(self.features)) - self.components.T @ self.components
        limit = self.score_clip if self.score_clip is not None else np.inf

        def score(x: np.ndarray) -> np.ndarray:
            return np.minimum(((((x - mean) / std) @ rest.T) ** 2).mean(axis=1), limit)

        if self.score_clip is None:  # a quadratic form of the standardised record: matrix, and z = x * scale + shift
            score.quadratic = (rest.T @ rest / len(mean), 1.0 / std, -mean / std)
        return score

    def meta(self) -> dict:
        return super().meta() | {
            "k": self.k, "components": self.components.tolist(), "scaler": asdict(self.scaler),
        }
