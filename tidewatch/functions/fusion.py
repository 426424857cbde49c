"""Score fusion formulas. A null score means the detector did not run on that record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schemas import FUSION_WEIGHTS, RATIO_WEIGHTS, SUPERVISED_WEIGHTS

EPS = 1e-8


def clip(value: Column, low: float, high: float) -> Column:
    """Clip that keeps null: ``least``/``greatest`` alone would turn a missing score into a bound."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low))))


def check_weights(weights: Sequence[float]) -> None:
    if abs(sum(weights) - 1.0) >= 1e-6:
        raise ValueError(f"weights must sum to 1, got {sum(weights)}")


def weighted(scores: Mapping[str, Column], weights: Mapping[str, float] = FUSION_WEIGHTS) -> Column:
    """Weighted mean over the scores present on the row; the weights of absent ones are shared out."""
    check_weights(list(weights.values()))
    _need(scores)
    total = sum((F.when(c.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, c in scores.items()), F.lit(0.0))
    value = sum((F.coalesce(c * F.lit(weights[k]), F.lit(0.0)) for k, c in scores.items()), F.lit(0.0))
    return F.when(total > 0, value / total)


def highest(scores: Mapping[str, Column]) -> Column:
    _need(scores)
    columns = list(scores.values())
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def vote(scores: Mapping[str, Column]) -> Column:
    """Share of the present detectors whose score reaches 0.5."""
    _need(scores)
    present = sum((c.isNotNull().cast("int") for c in scores.values()), F.lit(0))
    ayes = sum((F.coalesce((c >= 0.5).cast("int"), F.lit(0)) for c in scores.values()), F.lit(0))
    return F.when(present > 0, ayes / present)


def by_strategy(strategy: str, scores: Mapping[str, Column], weights: Mapping[str, float] = FUSION_WEIGHTS) -> Column:
    if strategy == "weighted_avg":
        return weighted(scores, weights)
    if strategy == "max":
        return highest(scores)
    if strategy == "vote":
        return vote(scores)
    raise ValueError(f"unknown fusion strategy: {strategy}")


def supervised(
    probability: Column, error: Column, error_threshold: float, weights: Sequence[float] = SUPERVISED_WEIGHTS
) -> Column:
    """A classifier's probability backed by the reconstruction error relative to its threshold."""
    check_weights(weights)
    ratio = clip(error / F.lit(max(error_threshold, EPS)), 0, 3) / 3
    return clip(F.lit(weights[0]) * clip(probability, 0, 1) + F.lit(weights[1]) * ratio, 0, 1)


def threshold_ratio(
    first: Column, second: Column, first_threshold: float, second_threshold: float,
    weights: Sequence[float] = RATIO_WEIGHTS,
) -> Column:
    """Two scores on unlike scales, each relative to its own threshold; both at threshold gives 0.5."""
    check_weights(weights)
    a = clip(first / F.lit(max(first_threshold, EPS)), 0, 3)
    b = clip(second / F.lit(max(second_threshold, EPS)), 0, 3)
    return clip((F.lit(weights[0]) * a + F.lit(weights[1]) * b) / 2, 0, 1)


def bounds_normalized(score: Column, low: float | None, high: float | None) -> Column:
    """Score mapped to [0, 1] by the bounds seen in training; without bounds it is left alone."""
    if low is None or high is None:
        return score
    return clip((score - F.lit(low)) / F.lit(high - low + EPS), 0, 1)


def _need(scores: Mapping[str, Column]) -> None:
    if not scores:
        raise ValueError("at least one score column is needed")
