"""Isolation forest: trees grown as grouped tasks, scored on Arrow batches.

Each tree sees a few hundred sampled rows, so growing one is a small task and 200 trees are 200 groups of
bounded size. The forest, at most ``trees * 2 * sample`` nodes, is the only thing that is broadcast.
Rows, features and split points are drawn by hashes of key, tree and node, so the forest does not depend on how the table is
laid out, and another engine can grow the same one. Trees need no scaling of the features.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.detectors.base import Detector
from tidewatch.detectors.trees import TreeTable
from tidewatch.operators.features import require_columns
from tidewatch.schemas import FIT_PERCENTILE

PRIME = 2_147_483_647
NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, path double, rows int"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def tree_depth(sample: int) -> int:
    return max(1, int(np.ceil(np.log2(max(sample, 2)))))


def chance(seed: int, tree: int, node: int, what: str) -> float:
    """A repeatable number in [0, 1) that any engine with md5 can compute."""
    return int(hashlib.md5(f"{seed}:{tree}:{node}:{what}".encode()).hexdigest()[:13], 16) / 16.0 ** 13


def tree_multipliers(trees: int, seed: int) -> list[tuple[int, int]]:
    """Per tree a factor and a shift modulo ``PRIME``, which turn one hash of a key into a draw per tree."""
    return [(1 + int(chance(seed, t, 0, "factor") * (PRIME - 1)), int(chance(seed, t, 0, "shift") * PRIME)) for t in range(trees)]


def grow(points: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple]:
    """Nodes (node, feature, split, left, right, path, rows) of one tree, level by level; a leaf has feature -1.

    Children of node i are 2 i + 1 and 2 i + 2. Which of the features that vary in a node splits it, and where between their
    least and largest value, is a hash of tree and node.
    """
    nodes: list[tuple] = []
    level = [(0, np.arange(len(points)))]
    for depth in range(limit + 1):
        below = []
        for node, rows in level:
            part = points[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth == limit or not len(usable):
                nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(rows)), len(rows)))
                continue
            feature = int(usable[int(chance(seed, tree, node, "feature") * len(usable))])
            split = float(low[feature] + chance(seed, tree, node, "split") * (high[feature] - low[feature]))
            goes_left = part[:, feature] <= split
            if not goes_left.any() or goes_left.all():  # a split that rounds to an end of the range
                nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(rows)), len(rows)))
                continue
            nodes.append((node, feature, split, 2 * node + 1, 2 * node + 2, 0.0, len(rows)))
            below += [(2 * node + 1, rows[goes_left]), (2 * node + 2, rows[~goes_left])]
        level = below
    return nodes


def forest_scores(points: np.ndarray, forest: dict[str, np.ndarray], scale: float) -> np.ndarray:
    """Walk all trees for a block of rows at once, one level per step.

    The node arrays hold all trees end to end. The right child follows the left one, and a leaf is its own
    left child behind a split no value exceeds, so every step is the same for all nodes.
    """
    points = np.ascontiguousarray(points)
    parts = [np.empty(0)]
    for start in range(0, len(points), 2048):
        block = points[start : start + 2048]
        row = (np.arange(len(block)) * block.shape[1])[:, None]
        flat = block.ravel()
        at = np.broadcast_to(forest["root"], (len(block), len(forest["root"])))
        for _ in range(forest["depth"]):
            goes_right = flat.take(row + forest["feature"].take(at)) > forest["split"].take(at)
            at = forest["left"].take(at) + goes_right
        parts.append(np.exp2(-forest["path"].take(at).mean(axis=1) / scale))
    return np.concatenate(parts)


class IsolationForest(Detector):
    kind = "iforest"

    def __init__(self, features: list[str], trees: int = 200, sample: int = 256, seed: int = 42):
        super().__init__(features)
        self.trees, self.sample, self.seed = trees, sample, seed
        self.nodes: pd.DataFrame | None = None
        self.used = sample

    def fit(self, normals: DataFrame, key: str, fraction: float | None = FIT_PERCENTILE) -> IsolationForest:
        """Learn from normal records; ``key`` must tell records apart, even if all their features agree."""
        require_columns(normals, self.features)
        n = normals.count()
        if not n:
            raise ValueError("cannot fit on an empty table")
        self.used = min(self.sample, n)
        # Every tree draws from all rows by a number of its own; what it draws has a size set by the parameters.
        share = min(1.0, (1.5 * self.used + 32) / n)
        hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.col(key).cast("string"))), 1, 7), 16, 10).cast("long")
        factors, shifts = (F.lit(np.array(x, dtype="int64")) for x in zip(*tree_multipliers(self.trees, self.seed)))

        def number(tree: Column) -> Column:
            return F.pmod(F.get(factors, tree) * F.col("_h") + F.get(shifts, tree), F.lit(PRIME))

        mine = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: number(t) <= int(share * PRIME))
        drawn = (
            normals.select(F.col(key).cast("string").alias("_key"), hashed.alias("_h"), F.array(*self.tree_input()).alias("_x"))
            .withColumn("tree", F.explode(mine)).withColumn("_u", number(F.col("tree")))
        )
        seed, used = self.seed, self.used
        limit = tree_depth(used)

        def plant(group: pd.DataFrame) -> pd.DataFrame:
            rows = group.sort_values(["_u", "_key"]).head(used)
            tree = int(rows["tree"].iloc[0])
            nodes = grow(np.stack(rows["_x"].to_numpy()), seed, tree, limit)
            out = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "path", "rows"])
            out.insert(0, "tree", tree)
            return out

        planted = drawn.groupBy("tree").applyInPandas(plant, NODE_SCHEMA)
        self.nodes = planted.toPandas().sort_values(["tree", "node"], ignore_index=True)  # size set by the parameters
        if fraction is not None:
            self.fit_bounds(normals, fraction)
        return self

    def packed(self) -> dict:
        """The node table as one array per field, in the layout ``forest_scores`` walks."""
        nodes = self.nodes
        width = int(nodes["node"].max()) + 1
        trees = nodes["tree"].nunique()
        at = (nodes["tree"] * width + nodes["node"]).to_numpy()
        leaf = (nodes["feature"] < 0).to_numpy()
        fields = {
            "feature": np.where(leaf, 0, nodes["feature"]),
            "split": np.where(leaf, np.inf, nodes["split"]),
            "left": np.where(leaf, at, nodes["tree"] * width + nodes["left"]),
            "path": nodes["path"].to_numpy(),
        }
        out = {}
        for name, values in fields.items():
            out[name] = np.zeros(trees * width, dtype="float64" if name in ("split", "path") else "int64")
            out[name][at] = values
        return out | {"root": np.arange(trees) * width, "depth": tree_depth(self.used)}

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """2^(-mean path / expected path): between 0 and 1, higher is more anomalous."""
        forest = df.sparkSession.sparkContext.broadcast(self.packed())
        scale = average_path(self.used) or 1.0

        @F.pandas_udf("double")
        def isolate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(forest_scores(batch.to_numpy(dtype="float64"), forest.value, scale))

        return df.withColumn(name, isolate(F.struct(*self.tree_input())))

    def on_arrays(self):
        forest, scale = self.packed(), average_path(self.used) or 1.0
        return lambda x: forest_scores(x, forest, scale)

    def tree_table(self) -> TreeTable:
        """Its raw output is the exponent of the score, minus mean path over expected path."""
        scale, trees = average_path(self.used) or 1.0, self.nodes["tree"].nunique()
        nodes = self.nodes.rename(columns={"path": "value", "rows": "cover"})
        return TreeTable.of(nodes, np.full(int(nodes["tree"].max()) + 1, -1.0 / (scale * trees)))

    def tree_input(self) -> list[Column]:
        return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in self.features]

    def meta(self) -> dict:
        return super().meta() | {
            "trees": self.trees, "sample": self.sample, "seed": self.seed, "used": self.used,
        }
