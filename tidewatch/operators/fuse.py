"""Score fusion over tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fusion
from tidewatch.operators.scaling import minmax_normalize
from tidewatch.schemas import FUSION_WEIGHTS

SCORE_COLUMNS = ["if_score", "ae_score", "bert_score"]


def join_scores(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Score tables of several detectors side by side; a detector that skipped a record leaves a null."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def apply_threshold(df: DataFrame, score: str, threshold: float, name: str = "is_anomaly_pred") -> DataFrame:
    """1 at or above the threshold, else 0."""
    return df.withColumn(name, (F.col(score) >= F.lit(float(threshold))).cast("int"))


def fuse_dataframe(
    df: DataFrame,
    strategy: str = "weighted_avg",
    weights: Mapping[str, float] = FUSION_WEIGHTS,
    threshold: float = 0.5,
    normalize: bool = True,
) -> DataFrame:
    """Add ``fused_score`` and ``is_anomaly_pred`` from whichever of the score columns the table has."""
    present = [c for c in SCORE_COLUMNS if c in df.columns]
    if not present:
        raise ValueError(f"at least one score column of {SCORE_COLUMNS} is needed")
    scaled = df.withColumns({f"_n_{c}": F.col(c) for c in present})
    if normalize:
        scaled = minmax_normalize(scaled, [f"_n_{c}" for c in present])
    fused = fusion.by_strategy(strategy, {c: F.col(f"_n_{c}") for c in present}, weights)
    out = scaled.withColumn("fused_score", fused).drop(*[f"_n_{c}" for c in present])
    return apply_threshold(out, "fused_score", threshold)


def route_fusion(
    df: DataFrame,
    modality: str = "network",
    supervised: str = "sup_score",
    reconstruction: str = "ae_score",
    isolation: str = "if_score",
    own: str = "score",
    reconstruction_threshold: float | None = None,
    isolation_threshold: float | None = None,
    name: str = "fused_score",
) -> DataFrame:
    """The best fusion each row allows.

    Network rows: classifier with reconstruction, else isolation with reconstruction, else isolation
    alone, else 0. Log and metric rows have a score of their own, a missing one counts as 0.
    """
    if modality not in ("network", "metric", "log"):
        raise ValueError(f"unknown modality: {modality}")
    if modality != "network":
        return df.withColumn(name, F.coalesce(F.col(own), F.lit(0.0)))

    def column(c: str):
        return F.col(c) if c in df.columns else F.lit(None).cast("double")

    sup, rec, iso = column(supervised), column(reconstruction), column(isolation)
    steps = []
    if reconstruction_threshold is not None:
        steps.append(fusion.supervised(sup, rec, reconstruction_threshold))
        if isolation_threshold is not None:
            steps.append(fusion.threshold_ratio(iso, rec, isolation_threshold, reconstruction_threshold))
    return df.withColumn(name, F.coalesce(*steps, iso, F.lit(0.0)))
