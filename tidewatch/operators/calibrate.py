"""Threshold search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.fusion import check_weights, clip
from tidewatch.operators.evaluate import ranking_points, score_counts
from tidewatch.operators.ordering import exact_quantile, position_in
from tidewatch.schemas import FUSION_WEIGHTS, LOG_THRESHOLD, RECALL_FLOORS

_EPS = 1e-9


def threshold_max_f1(
    df: DataFrame, score: str, label: str, min_recall: float = 0.0, by: Sequence[str] = ()
) -> DataFrame:
    """Threshold of best F1 among those that keep recall at or above the floor; a tie takes the lowest.

    Without positives the threshold is null.
    """
    if min_recall > 1:
        raise ValueError("recall floor above 1 can never be met")
    points = ranking_points(score_counts(df, score, label, by), by)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.when(F.col("tp_total") > 0, F.col("tp") / F.col("tp_total"))
    scored = points.withColumns({"_p": precision, "_r": recall}).withColumn(
        "_f1", 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r") + _EPS)
    )
    rank = F.struct(F.col("_f1"), -F.col("score"), F.col("_r"), F.col("score"))
    best = F.max(F.when(F.col("_r") >= min_recall, rank))
    return scored.groupBy(*by).agg(best.alias("_best")).select(
        *by,
        F.col("_best.score").alias("threshold"), F.col("_best._f1").alias("f1"), F.col("_best._r").alias("recall"),
    )


def threshold_percentile(df: DataFrame, score: str, fraction: float, exact: bool = True) -> float | None:
    """Quantile of the scores, exact by default; ``exact=False`` takes a one-pass sketch."""
    if exact:
        return exact_quantile(df, score, fraction)
    return df.agg(F.percentile_approx(score, fraction, 100_000)).first()[0]


def score_clip_from_normals(df: DataFrame, score: str, label: str) -> float | None:
    """Upper clip for an unbounded score: twice the 99th percentile of the normals."""
    high = exact_quantile(df.where(F.col(label).cast("int") == 0), score, 0.99)
    return None if high is None else 2 * high


def clip_scores(df: DataFrame, score: str, limit: float | None, name: str | None = None) -> DataFrame:
    value = F.col(score) if limit is None else clip(F.col(score), 0, limit)
    return df.withColumn(name or score, value)


def threshold_clipped(df: DataFrame, score: str, label: str, min_recall: float = 0.90) -> DataFrame:
    """Clip by the normals, then search for the best F1 on the clipped scores."""
    limit = score_clip_from_normals(df, score, label)
    found = threshold_max_f1(clip_scores(df, score, limit), score, label, min_recall)
    return found.withColumn("score_clip", F.lit(limit))


def even_grid(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [i * step + low for i in range(n - 1)] + [high]


def threshold_grid(df: DataFrame, score: str, label: str, n: int = 200) -> DataFrame:
    """Best F1 over ``n`` evenly spaced thresholds; the first best wins.

    Each row is placed between two grid points and only the counts per grid point are summed up, so the
    work does not grow with rows times grid.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    low, high = known.agg(F.min(F.col(score).cast("double")), F.max(F.col(score).cast("double"))).first()
    if low is None:
        raise ValueError("no scores")
    grid = even_grid(low, high, n)
    positive = F.col(label).cast("int")
    counts = known.groupBy((position_in(grid, F.col(score).cast("double")) - 1).alias("slot")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    slots = df.sparkSession.createDataFrame(list(enumerate(grid)), "slot int, threshold double")
    above = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)  # n grid rows, not data rows
    whole = Window.partitionBy()
    points = slots.join(counts, "slot", "left").select(
        "slot", "threshold",
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp"),
        F.coalesce(F.sum("pos").over(whole), F.lit(0)).alias("total"),
    )
    f1 = F.when(F.col("tp") + F.col("fp") + F.col("total") > 0,
                2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("total"))).otherwise(0.0)
    best = F.max(F.struct(f1.alias("f1"), -F.col("slot"), F.col("threshold")))
    return points.agg(best.alias("b")).select(
        F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(0.0).alias("threshold"), F.col("b.f1").alias("f1")
    )


def threshold_at_recall(df: DataFrame, score: str, label: str, recall: float = 0.95) -> DataFrame:
    """Highest threshold that still reaches the recall."""
    points = ranking_points(score_counts(df, score, label))
    enough = (F.col("tp_total") > 0) & (F.col("tp") / F.col("tp_total") >= recall)
    return points.agg(F.max(F.when(enough, F.col("score"))).alias("threshold"))


@dataclass
class FusionConfig:
    """How scores are fused and, per modality, the threshold calibrated for that very score."""

    weights: dict[str, float] = field(default_factory=lambda: dict(FUSION_WEIGHTS))
    strategy: str = "weighted_avg"
    threshold: float = 0.5
    network_threshold: float = 0.5
    log_threshold: float = LOG_THRESHOLD

    def __post_init__(self):
        check_weights(list(self.weights.values()))
        if self.strategy not in ("weighted_avg", "max", "vote"):
            raise ValueError(f"unknown fusion strategy: {self.strategy}")

    def threshold_for(self, modality: str) -> float:
        if modality == "network":
            return self.network_threshold
        return self.log_threshold if modality == "log" else self.threshold


def calibrate_pipeline(
    frames: Mapping[str, DataFrame], score: str, label: str, floors: Mapping[str, float] = RECALL_FLOORS
) -> FusionConfig:
    """Best-F1 threshold per modality, the network one above its recall floor."""
    config = FusionConfig()
    targets = {"metric": "threshold", "network": "network_threshold", "log": "log_threshold"}
    for modality, df in frames.items():
        found = threshold_max_f1(df, score, label, floors.get(modality, 0.0)).first()["threshold"]
        if found is not None:
            setattr(config, targets[modality], found)
    return config
