"""Exact detection metrics over whole tables.

All ranking metrics start from ``score_counts``: one row per distinct score with its positives and
negatives. That is a plain aggregation (summed per task before the shuffle, so a score shared by a third
of the rows is one row), after which the running totals of ``ordering`` give every curve.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import running_totals
from tidewatch.session import durable

NO_GAP_AUC, NO_GAP_MISS, FAIR_AUC = 0.95, 0.15, 0.85  # fixed values: limits of the verdict


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score. Rows without a score or label do not count."""
    positive = F.col(label).cast("int")
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.sum(positive).cast("long").alias("pos"), F.sum(1 - positive).cast("long").alias("neg"))
    )


def ranking_points(counts: DataFrame, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Per distinct score: hits ``tp`` and false alarms ``fp`` if that score were the threshold."""
    down = counts.withColumn("_down", -F.col("score"))
    points = running_totals(down, {"tp": F.col("pos"), "fp": F.col("neg")}, ["_down"], by, buckets, totals=True)
    return points.drop("_down")


def pr_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per distinct score, and the closing point (1, 0) without a threshold."""
    points = ranking_points(score_counts(df, score, label, by), by).select(
        *by,
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("tp_total") > 0, F.col("tp") / F.col("tp_total")).alias("recall"),
    )
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    closing = groups.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(closing)


def roc_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate per distinct score."""
    return ranking_points(score_counts(df, score, label, by), by).select(
        *by,
        F.col("score").alias("threshold"),
        F.when(F.col("fp_total") > 0, F.col("fp") / F.col("fp_total")).alias("fpr"),
        F.when(F.col("tp_total") > 0, F.col("tp") / F.col("tp_total")).alias("tpr"),
    )


def _auc() -> Column:
    """Share of (positive, negative) pairs ranked the right way, ties counted half; 0 with one class only."""
    neg, pos = F.col("neg").cast("double"), F.col("pos").cast("double")
    pairs = F.sum(neg * (F.col("tp") - F.col("pos")) + neg * pos / 2)
    all_pairs = F.max("tp_total").cast("double") * F.max("fp_total").cast("double")
    return F.coalesce(F.when(all_pairs > 0, pairs / all_pairs), F.lit(0.0))


def _average_precision() -> Column:
    """Step sum of precision over the recall gained at each threshold."""
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return F.coalesce(F.when(F.max("tp_total") > 0, F.sum(step) / F.max("tp_total")), F.lit(0.0))


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC and average precision from one pass over the ranking points."""
    points = ranking_points(score_counts(df, score, label, by), by)
    return points.groupBy(*by).agg(_auc().alias("roc_auc"), _average_precision().alias("avg_precision"))


def confusion(df: DataFrame, prediction: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of 0/1 predictions."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    def cell(name: str, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    return df.groupBy(*by).agg(
        cell("tp", (y == 1) & (p == 1)), cell("fp", (y == 0) & (p == 1)),
        cell("fn", (y == 1) & (p == 0)), cell("tn", (y == 0) & (p == 0)),
    )


def with_prf(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from confusion columns, guarded against empty denominators."""
    one = F.lit(1).cast("long")
    precision = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)
    recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)
    return df.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1",
        2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8)),
    )


def prf(df: DataFrame, prediction: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return with_prf(confusion(df, prediction, label, by))


def classification_report(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """One row per class and for accuracy, macro and weighted average; an empty ratio counts as 0."""
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sides = {"0": (tn, fn, fp), "1": (tp, fp, fn)}
    wide = confusion(df, prediction, label)
    for cls, (right, wrong, lost) in sides.items():
        wide = wide.withColumns({
            f"p{cls}": ratio(right, right + wrong), f"r{cls}": ratio(right, right + lost), f"s{cls}": right + lost,
        })
        p, r = F.col(f"p{cls}"), F.col(f"r{cls}")
        wide = wide.withColumn(f"f{cls}", ratio(2 * p * r, p + r))
    support = F.col("s0") + F.col("s1")

    def line(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("support")
        )

    def macro(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def by_support(m: str) -> Column:
        return ratio(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), support)

    accuracy = ratio(tp + tn, support)
    lines = F.array(
        *[line(c, F.col(f"p{c}"), F.col(f"r{c}"), F.col(f"f{c}"), F.col(f"s{c}")) for c in sides],
        line("accuracy", accuracy, accuracy, accuracy, support),
        line("macro avg", macro("p"), macro("r"), macro("f"), support),
        line("weighted avg", by_support("p"), by_support("r"), by_support("f"), support),
    )
    return wide.select(F.inline(lines))


def evaluate(
    df: DataFrame, score: str, label: str, threshold: float | Mapping[str, float], by: str | None = None
) -> DataFrame:
    """Full metric row(s): ranking metrics, threshold metrics and counts, from one table of score counts.

    With ``by`` (for example a detector column) ``threshold`` may map each group to its own value.
    """
    keys = [by] if by else []
    if isinstance(threshold, Mapping):
        pairs = [F.lit(x) for kv in threshold.items() for x in (kv[0], float(kv[1]))]
        limit = F.try_element_at(F.create_map(*pairs), F.col(by))
    else:
        limit = F.lit(float(threshold))
    flagged = F.col("score") >= limit
    points = ranking_points(score_counts(df, score, label, keys), keys)
    def count(column: str, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(column)).otherwise(0)), F.lit(0)).cast("long")
    summed = points.groupBy(*keys).agg(
        _auc().alias("roc_auc"), _average_precision().alias("avg_precision"),
        count("pos", flagged).alias("tp"), count("neg", flagged).alias("fp"),
        count("pos", ~flagged).alias("fn"), count("neg", ~flagged).alias("tn"),
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    metrics = ["roc_auc", "avg_precision", "precision", "recall", "f1", "accuracy"]
    return (
        with_prf(summed)
        .withColumn("accuracy", F.when(n > 0, (F.col("tp") + F.col("tn")) / n).otherwise(0.0))
        .select(
            *keys,
            *[F.round(m, 4).alias(m) for m in metrics],
            n.alias("n_samples"),
            (F.col("tp") + F.col("fn")).alias("n_true"),
            (F.col("tp") + F.col("fp")).alias("n_pred"),
        )
    )


def stack_scores(df: DataFrame, scores: Mapping[str, str], label: str, name: str = "detector") -> DataFrame:
    """Long form of several score columns: one row per record and detector, in a single read."""
    return df.select(label, *scores.values()).unpivot([label], list(scores.values()), name, "score").replace(
        {column: shown for shown, column in scores.items()}, subset=[name]
    )


def compare_detectors(
    df: DataFrame, scores: Mapping[str, str], label: str, thresholds: Mapping[str, float]
) -> DataFrame:
    """One metric row per detector, each against its own threshold."""
    return evaluate(stack_scores(df, scores, label), "score", label, thresholds, by="detector")


def recall_by_type(df: DataFrame, prediction: str, kind: str, normal: str = "Normal") -> DataFrame:
    """Share of each attack type that was caught."""
    return (
        df.where(F.col(kind).isNotNull() & (F.col(kind) != normal))
        .groupBy(kind)
        .agg(F.avg(F.col(prediction).cast("double")).alias("recall"), F.count("*").alias("n"))
    )


def false_negatives(df: DataFrame, prediction: str, label: str) -> DataFrame:
    return df.where((F.col(label).cast("int") == 1) & (F.col(prediction).cast("int") == 0))


def false_positives(df: DataFrame, prediction: str, label: str) -> DataFrame:
    return df.where((F.col(label).cast("int") == 0) & (F.col(prediction).cast("int") == 1))


def recovered(missed_before: DataFrame, missed_after: DataFrame, key: str) -> DataFrame:
    """Records the first detector missed and the second did not."""
    return missed_before.join(missed_after.select(key), key, "left_anti")


def still_missed(missed_before: DataFrame, missed_after: DataFrame, key: str) -> DataFrame:
    """Records both detectors missed."""
    return missed_before.join(missed_after.select(key), key, "left_semi")


def recovery_report(df: DataFrame, before: str, after: str, label: str) -> DataFrame:
    """Records missed by ``before``, tagged by whether ``after`` catches them.

    Both predictions sit on the same row, so neither set needs a join.
    """
    outcome = F.when(F.col(after).cast("int") == 1, "recovered").otherwise("still_missed")
    return false_negatives(df, before, label).withColumn("outcome", outcome)


def generalization_verdict(row: DataFrame) -> DataFrame:
    """Says whether a detector holds up on fresh data, from its metric row."""
    miss = 1 - F.col("recall")
    verdict = (
        F.when((F.col("roc_auc") >= NO_GAP_AUC) & (miss < NO_GAP_MISS), "holds")
        .when(F.col("roc_auc") >= FAIR_AUC, "reasonable")
        .otherwise("gap")
    )
    return row.withColumn("verdict", verdict)


def drift_compare(phases: Mapping[str, DataFrame]) -> DataFrame:
    """The same metric row for several phases (say before and after retraining), one under another."""
    out = None
    for name, row in phases.items():
        tagged = row.withColumn("phase", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no phase given")
    return out


def compare_strategies(df: DataFrame, fused: Mapping[str, str], label: str, threshold: float = 0.5) -> DataFrame:
    """ROC AUC and F1 of several fused score columns at one threshold."""
    long = stack_scores(df, fused, label, "strategy")
    return evaluate(long, "score", label, threshold, by="strategy").select("strategy", "roc_auc", "f1")
