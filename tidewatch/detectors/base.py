"""What all detectors share: feature list, training threshold and score bounds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fusion import bounds_normalized
from tidewatch.operators.ordering import exact_quantiles
from tidewatch.schemas import FIT_PERCENTILE
from tidewatch.session import durable


class Detector:
    kind = ""

    def __init__(self, features: list[str]):
        self.features = list(features)
        self.threshold: float | None = None
        self.score_min: float | None = None
        self.score_max: float | None = None
        self.score_clip: float | None = None

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        raise NotImplementedError

    def on_arrays(self) -> Callable[[np.ndarray], np.ndarray]:
        """The same score as a function of a matrix of raw features, for use inside a pandas UDF."""
        raise NotImplementedError

    def fit_bounds(self, df: DataFrame, fraction: float = FIT_PERCENTILE) -> None:
        """Threshold at a quantile of the training scores, and the bounds of these scores."""
        found = exact_quantiles(self.score(df, "_score"), "_score", [0.0, fraction, 1.0]).get((), {})
        self.score_min, self.threshold, self.score_max = (found.get(f) for f in (0.0, fraction, 1.0))

    def calibrate(self, labelled: DataFrame, label: str = "is_anomaly", min_recall: float = 0.90) -> None:
        """Learn clip, threshold and bounds from labelled records: scores are clipped at twice the 99th percentile of the normals,
        so that extreme anomalies do not push the threshold over mild ones, and the threshold has the best F1 above the recall floor.

        Without positives or without normals the clip is left out or the threshold is that of ``fit_bounds``.
        """
        from tidewatch.operators.calibrate import score_clip_from_normals, threshold_max_f1

        self.score_clip = None
        scored = durable(self.score(labelled.where(F.col(label).isNotNull()), "_score").select("_score", label))
        self.score_clip = score_clip_from_normals(scored, "_score", label)
        clipped = scored if self.score_clip is None else scored.withColumn("_score", F.least("_score", F.lit(self.score_clip)))
        found = threshold_max_f1(clipped, "_score", label, min_recall).first()
        bounds = exact_quantiles(clipped, "_score", [0.0, FIT_PERCENTILE, 1.0]).get((), {})
        self.score_min, self.score_max = bounds.get(0.0), bounds.get(1.0)
        self.threshold = found["threshold"] if found and found["threshold"] is not None else bounds.get(FIT_PERCENTILE)

    def normalized(self, score: Column) -> Column:
        return bounds_normalized(score, self.score_min, self.score_max)

    def predict(self, df: DataFrame, name: str = "prediction", score: str = "score") -> DataFrame:
        return self.score(df, score).withColumn(name, (F.col(score) >= F.lit(self.threshold)).cast("int"))

    def meta(self) -> dict:
        return {
            "features": self.features, "threshold": self.threshold,
            "score_min": self.score_min, "score_max": self.score_max, "score_clip": self.score_clip,
        }

    def restore(self, meta: dict) -> None:
        for field in ("threshold", "score_min", "score_max", "score_clip"):
            setattr(self, field, meta.get(field))


def batch_score(df: DataFrame, detectors: dict[str, Detector]) -> DataFrame:
    """Every detector's score as a column of its own, on the same pass over the rows."""
    for name, detector in detectors.items():
        df = detector.score(df, name)
    return df


def custom_score(
    df: DataFrame, features: list[str], scorer: Callable[[pd.DataFrame], pd.Series], name: str = "score"
) -> DataFrame:
    """Score with any function of a pandas batch of features; it runs on Arrow batches inside the tasks."""
    @F.pandas_udf("double")
    def apply(batch: pd.DataFrame) -> pd.Series:
        return scorer(batch)

    columns = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    return df.withColumn(name, apply(columns))
