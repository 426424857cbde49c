"""Shapley attribution of any detector, row by row.

The value of a feature set S for a record x is the mean score over the background records with the
features of S taken from x. Rows stay where they are; the background, at most a few hundred rows, travels
with the function; a larger one is refused, draw it with ``background_sample``. There is no cap on how many records may
be explained.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.detectors.trees import PathTables, mean_output
from tidewatch.operators.explain import sorted_attribution

EXACT_FEATURES = 15  # 2^d feature sets per record; the exact method takes no more
BLOCK = 32_768  # matrix rows scored at a time


def coalition_value(x: np.ndarray, background: np.ndarray, members: np.ndarray, score) -> np.ndarray:
    mixed = np.where(members[None, None, :], x[:, None, :], background[None, :, :])
    return score(mixed.reshape(-1, x.shape[1])).reshape(len(x), len(background)).mean(axis=1)


def exact_values(x: np.ndarray, background: np.ndarray, score) -> np.ndarray:
    d = x.shape[1]
    masks = np.arange(1 << d)
    bits = (masks[:, None] >> np.arange(d)) & 1
    value = np.stack([coalition_value(x, background, b.astype(bool), score) for b in bits])
    size = bits.sum(axis=1)
    weight = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) if s < d else 0.0 for s in size])
    out = np.empty_like(x)
    for i in range(d):
        without = masks[bits[:, i] == 0]
        gain = value[without | (1 << i)] - value[without]
        out[:, i] = (weight[without, None] * gain).sum(axis=0)
    return out


def quadratic_values(x: np.ndarray, background: np.ndarray, form: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The exact values of a score z'Az with z = x * scale + shift, from the background's first two moments.

    Over all feature sets the value of feature i against one background record b is (z_i - b_i) * (A(z + b))_i; its mean over the
    background takes as many steps as A has numbers, instead of two to the power of the features times the background.
    """
    matrix, scale, shift = form
    z, b = x * scale + shift, background * scale + shift
    mean, second = b.mean(axis=0), b.T @ b / len(b)
    mixed = z @ matrix
    return z * mixed + z * (mean @ matrix) - mean * mixed - (matrix * second).sum(axis=1)


def sampled_values(x: np.ndarray, background: np.ndarray, score, orders: np.ndarray) -> np.ndarray:
    """Mean gain along feature orders; each order hands out the full difference, so the sum is exact."""
    out = np.zeros_like(x)
    start = coalition_value(x, background, np.zeros(x.shape[1], dtype=bool), score)
    for order in orders:
        members, before = np.zeros(x.shape[1], dtype=bool), start
        for i in order:
            members[i] = True
            after = coalition_value(x, background, members, score)
            out[:, i] += after - before
            before = after
    return out / len(orders)


def shapley(
    df: DataFrame,
    features: Sequence[str],
    scorer: Callable[[np.ndarray], np.ndarray],
    background: DataFrame,
    method: str,
    orders: int = 16,
    background_rows: int = 200,
    seed: int = 42,
    name: str = "attribution",
) -> DataFrame:
    """Add the attribution of ``scorer`` (a function of a feature matrix) to every row.

    ``method`` is ``exact`` (all feature sets) or ``sampled`` (``orders`` feature orders). The background may hold
    ``background_rows`` rows at most. A scorer with an attribute ``quadratic`` is a quadratic form, whose exact values are known
    from moments of the background.
    """
    d = len(features)
    if method not in ("exact", "sampled"):
        raise ValueError(f"unknown method: {method}")
    exact = method == "exact"
    if exact and d > EXACT_FEATURES:
        raise ValueError(f"the exact method takes at most {EXACT_FEATURES} features, got {d}")
    value = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    base = background.select(*value).limit(background_rows + 1).toPandas().to_numpy(dtype="float64")
    if not 0 < len(base) <= background_rows:
        raise ValueError(f"background must hold 1 to {background_rows} rows")
    rng = np.random.default_rng(seed)
    half = [rng.permutation(d) for _ in range(max(1, orders // 2))]
    paths = np.array(half + [p[::-1] for p in half])
    form = getattr(scorer, "quadratic", None) if exact else None

    @F.pandas_udf("array<double>")
    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        block = max(1, BLOCK // len(base))
        for batch in batches:
            x = batch.to_numpy(dtype="float64")
            rows: list[np.ndarray] = []
            for at in range(0, len(x), block):
                part = x[at : at + block]
                if form is not None:
                    rows.extend(quadratic_values(part, base, form))
                else:
                    rows.extend(exact_values(part, base, scorer) if exact else sampled_values(part, base, scorer, paths))
            yield pd.Series(rows, dtype="object")

    # A few alerts can sit in one partition, and each costs thousands of scores: spread them first.
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    spread = df if df.isStreaming else df.repartition(tasks)
    found = spread.withColumn("_phi", attribute(F.struct(*value)))
    parts = {c: F.round(F.get("_phi", i), 6) for i, c in enumerate(features)}
    return found.withColumn(name, sorted_attribution(parts)).drop("_phi")


def tree_shapley(df: DataFrame, detector, name: str = "attribution", raw: str | None = None, base: str | None = None) -> DataFrame:
    """Add the attribution of a tree ensemble's raw output to every row, exact for any number of features.

    ``detector`` is a fitted ``BoostedTrees`` or ``IsolationForest``. What is broadcast are the tables of its subtrees (``PathTables``), at most
    trees * 2 ** depth * CELL_BITS * 2 ** CELL_BITS numbers. ``raw`` and ``base`` name columns for the raw output and
    its mean over the training rows; the values add up to their difference. Shares are those of the training rows, so no background table is read.
    """
    table = detector.tree_table()
    held = df.sparkSession.sparkContext.broadcast((PathTables(table), table))
    d = len(detector.features)

    @F.arrow_udf("struct<values: array<double>, raw: double>")
    def attribute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        paths, nodes = held.value
        for batch in batches:
            x = np.stack([batch.field(i).to_numpy(zero_copy_only=False) for i in range(d)], axis=1)
            ends = pa.array(np.arange(len(x) + 1, dtype="int32") * d)
            values = pa.ListArray.from_arrays(ends, pa.array(paths.values(x).ravel()))
            yield pa.StructArray.from_arrays([values, pa.array(nodes.raw(x))], ["values", "raw"])

    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    spread = df if df.isStreaming else df.repartition(tasks)
    found = spread.withColumn("_phi", attribute(F.struct(*detector.tree_input())))
    parts = {c: F.round(F.get(F.col("_phi.values"), i), 9) for i, c in enumerate(detector.features)}
    found = found.withColumn(name, sorted_attribution(parts))
    if raw:
        found = found.withColumn(raw, F.col("_phi.raw"))
    if base:
        found = found.withColumn(base, F.lit(mean_output(table.paths())))
    return found.drop("_phi")
