"""Boosted regression trees over binned rows: the training behind ``BoostedTrees``.

Every feature is cut into at most 32 bins once, and rows become small integers in chunks of ``CHUNK`` that executors keep. A job per
level of a tree sums, per node, feature and bin, how many rows of either class there are and their residuals; the driver picks
the splits from these sums. Only the smaller of two siblings is summed, the other one is what is left of their parent. A
chunk carries the output of all trees so far, so that a tree costs the same however many came before. What reaches
the driver are sums, never rows, and a task holds one chunk at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import remove_at_exit, shared_folder

BINS = 32
CHUNK = 1 << 16
SPLIT_ROWS = 10_000  # rows that the cuts between bins are read off, as many as MLlib takes
CHECKPOINT_TREES = 30
DRIVER_PARTS = 64  # from more tasks than that, sums are added up inside Spark first


def cuts(values: np.ndarray) -> np.ndarray:
    """Upper ends of all bins but the last: halfway between neighbouring values, or about equally many values to a bin."""
    found, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(found) <= BINS:
        return (found[:-1] + found[1:]) / 2
    steps = counts.sum() / BINS * np.arange(1, BINS)
    ends = np.unique(np.searchsorted(np.cumsum(counts), steps - 1e-9))
    ends = ends[ends < len(found) - 1]
    return (found[ends] + found[ends + 1]) / 2


@dataclass
class Tree:
    """Nodes in the order they were made, children after their parent; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    sum: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, rows: int, cover: float, total: float) -> int:
        for name, value in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("rows", rows), ("cover", cover), ("sum", total), ("gain", 0.0)):
            getattr(self, name).append(value)
        return len(self.feature) - 1

    def value(self) -> np.ndarray:
        return np.array(self.sum) / np.array(self.cover)


def marked(bins: np.ndarray, tree: Tree, wanted: dict[int, int]) -> np.ndarray:
    """The number that ``wanted`` gives the node each row comes to, 0 where it comes to none of them.

    A split is a comparison of the small integers of a whole chunk, which costs a fraction of looking each row's node up. Branches
    without a wanted node are not entered, and one mark per level is held.
    """
    out = np.zeros(bins.shape[1], dtype=np.uint8 if max(wanted.values(), default=0) < 256 else np.int64)
    needed = np.zeros(len(tree.feature), dtype=bool)
    needed[list(wanted)] = True
    for node in range(len(tree.feature) - 1, -1, -1):  # children stand after their parent
        if tree.feature[node] >= 0:
            needed[node] |= needed[tree.left[node]] | needed[tree.right[node]]
    todo = [(0, np.ones(len(out), dtype=bool))] if needed[0] else []
    while todo:
        node, here = todo.pop()
        if node in wanted:
            out += here.view(np.uint8) * out.dtype.type(wanted[node])
            continue
        left, right = tree.left[node], tree.right[node]
        goes = bins[tree.feature[node]] <= tree.bin[node]
        goes &= here
        if needed[right]:
            todo.append((right, here & ~goes))
        if needed[left]:
            todo.append((left, goes))
    return out


def leaf_values(bins: np.ndarray, tree: Tree) -> np.ndarray:
    """The value of the leaf each row comes to."""
    leaves = [node for node, f in enumerate(tree.feature) if f < 0]
    return tree.value()[leaves].take(marked(bins, tree, {node: i for i, node in enumerate(leaves)}))


@dataclass(frozen=True)
class Plan:
    """What tasks need besides rows."""

    features: int
    depth: int
    share: float
    rate: float
    weight: float  # of a positive row
    seed: int

    def residual(self, chunk: dict, rows: np.ndarray, first: bool) -> np.ndarray:
        """Weighted residuals of the log loss; the first tree learns the labels themselves."""
        sign = np.where(chunk["y"][rows], 1.0, -1.0)
        found = sign if first else 4.0 * sign / (1.0 + np.exp(2.0 * sign * chunk["out"][rows]))
        return found * np.where(chunk["y"][rows], self.weight, 1.0)

    def draw(self, chunk: dict, number: int) -> np.ndarray:
        """Which rows of a chunk a tree is grown on."""
        return np.random.default_rng([self.seed, number, *chunk["place"]]).random(len(chunk["y"]), dtype=np.float32) < self.share

    def sums(self, chunks: Iterator[dict], tree: Tree, number: int, slots: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Per node of ``slots``, feature, bin and class: rows, and residuals of both classes together."""
        size = len(slots) * BINS * 2
        count, total = np.zeros((self.features, size), dtype=np.int64), np.zeros((self.features, size))
        numbers = {node: slot + 1 for node, slot in slots.items()}
        for chunk in chunks:
            bins = chunk["bins"]
            mark = marked(bins, tree, numbers)
            rows = np.flatnonzero(self.draw(chunk, number) & (mark > 0))
            if not len(rows):
                continue
            residual = self.residual(chunk, rows, number == 0)
            start = (mark.take(rows).astype(np.int64) - 1) * (BINS * 2) + chunk["y"].take(rows) * BINS
            key = np.empty_like(start)
            for f in range(self.features):
                np.add(start, bins[f].take(rows), out=key)
                count[f] += np.bincount(key, minlength=size)
                total[f] += np.bincount(key, weights=residual, minlength=size)
        shape = (self.features, len(slots), 2, BINS)
        return count.reshape(shape).transpose(1, 0, 3, 2), total.reshape(shape).sum(axis=2).swapaxes(0, 1)

    def best_split(self, count: np.ndarray, total: np.ndarray, used: np.ndarray, levels: np.ndarray) -> tuple | None:
        """(gain, feature, bin, rows, weights and sums of both sides) of a node; None where no split gains anything."""
        cover = count[..., 0] + self.weight * count[..., 1]
        n, w, s = (np.cumsum(a, axis=1) for a in (count.sum(axis=2), cover, total))
        all_n, all_w, all_s = n[:, -1:], w[:, -1:], s[:, -1:]
        fits = (n > 0) & (n < all_n) & used[:, None] & (np.arange(BINS) < levels[:, None])
        if not fits.any():
            return None
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, (s * s / w + (all_s - s) ** 2 / (all_w - w) - all_s * all_s / all_w) / all_w, -np.inf)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] <= 1e-12:
            return None
        left = (int(n[f, b]), float(w[f, b]), float(s[f, b]))
        return float(gain[f, b]), int(f), int(b), left, (int(all_n[f, 0]) - left[0], float(all_w[f, 0]) - left[1], float(all_s[f, 0]) - left[2])


def _added(parts: RDD) -> tuple[np.ndarray, np.ndarray]:
    """Sum of (place, sums), few of them at the driver in the order of their places."""
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    if parts.getNumPartitions() > DRIVER_PARTS:
        return parts.values().treeReduce(add)
    return reduce(add, (sums for _, sums in sorted(parts.collect(), key=lambda x: x[0])))


def chunked(rows: DataFrame, features: int, limits: list[np.ndarray], keys: list[str], n: int) -> RDD:
    """The ``n`` rows (x0, x1, …, label, _h) as chunks of bins, in an order that does not depend on where they lay."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    names = [f"x{i}" for i in range(features)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, y, size, number = [], [], 0, 0

        def made() -> pa.RecordBatch:
            x, label = np.concatenate(bins, axis=1), np.concatenate(y)
            return pa.RecordBatch.from_pydict({"place": pa.array([TaskContext.get().partitionId()], pa.int32()), "number": pa.array([number], pa.int32()),
                                               "bins": [x.tobytes()], "y": [label.tobytes()]})

        for b in batches:
            bins.append(np.stack([np.searchsorted(limits[i], b.column(c).to_numpy(zero_copy_only=False)).astype(np.uint8) for i, c in enumerate(names)]))
            y.append(b.column("label").to_numpy(zero_copy_only=False) == 1)
            size += b.num_rows
            if size >= CHUNK:
                yield made()
                bins, y, size, number = [], [], 0, number + 1
        if size:
            yield made()

    def chunk(row) -> dict:
        y = np.frombuffer(row["y"], dtype=bool)
        return {"place": (row["place"], row["number"]), "bins": np.frombuffer(row["bins"], dtype=np.uint8).reshape(features, len(y)), "y": y,
                "out": np.zeros(len(y))}

    dealt = rows.repartition(tasks, "_h").sortWithinPartitions("_h", *keys)
    made = dealt.mapInArrow(encode, "place int, number int, bins binary, y binary").rdd.map(chunk)
    few = -(-n // CHUNK)
    if few >= tasks:
        return made
    # Less than a chunk for a task: starting tasks would take longer than their sums. The chunks, and so the sums of each place, stay as they are.
    return made.map(lambda c: (c["place"][0], c)).partitionBy(few, lambda place: place % few).mapPartitions(
        lambda part: [c for _, c in sorted(part, key=lambda x: x[1]["place"])])


def grow(chunks: RDD, plan: Plan, tree_number: int, levels: np.ndarray, columns: int) -> Tree:
    """One tree, level by level."""
    tree, known, wanted = Tree(), {}, {0: 0}
    tree.add(0, 0.0, 0.0)
    siblings: dict[int, tuple[int, int]] = {}  # node that was summed: its sibling and parent
    for level in range(plan.depth):
        count, total = _added(chunks.mapPartitions(lambda part, tree=tree, slots=wanted: (
            (place, plan.sums(own, tree, tree_number, slots)) for place, own in groupby(part, key=lambda chunk: chunk["place"][0]))))
        found = {node: (count[slot], total[slot]) for node, slot in wanted.items()}
        for node, (other, parent) in siblings.items():
            found[other] = (known[parent][0] - found[node][0], known[parent][1] - found[node][1])
        if not level:
            n, s = count[0, 0].sum(axis=0), float(total[0, 0].sum())
            if not n.sum():
                raise ValueError("no rows to train on")
            tree.rows[0], tree.cover[0], tree.sum[0] = int(n.sum()), float(n[0] + plan.weight * n[1]), s
        known, wanted, siblings = found, {}, {}
        for node in sorted(found):
            used = np.zeros(plan.features, dtype=bool)
            used[np.random.default_rng([plan.seed, tree_number, node, 1]).permutation(plan.features)[:columns]] = True
            best = plan.best_split(*found[node], used, levels)
            if best is None:
                continue
            tree.gain[node], tree.feature[node], tree.bin[node], left, right = best
            tree.left[node], tree.right[node] = tree.add(*left), tree.add(*right)
            small, large = sorted((tree.left[node], tree.right[node]), key=lambda c: tree.rows[c])
            wanted[small], siblings[small] = len(wanted), (large, node)
        if not wanted:
            break
    return tree


def boost(rows: DataFrame, features: list[str], label: str, weight: float, trees: int, depth: int, rate: float, row_share: float,
          column_share: float, seed: int) -> tuple[list[Tree], list[np.ndarray]]:
    """Trees and the cuts of every feature, from rows with a label of 0 or 1."""
    spark, d = rows.sparkSession, len(features)
    plain = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    coded = rows.select(*values, F.col(label).cast("double").alias("label"), F.xxhash64(F.lit(seed), *plain).alias("_h"))
    n = coded.count()
    if not n:
        raise ValueError("no rows to train on")
    names = [f"x{i}" for i in range(d)]
    taken = coded.where(F.pmod("_h", F.lit(1_000_003)) < F.lit(int(min(1.0, SPLIT_ROWS / n) * 1_000_003) + 1)).select(*names)
    sample = taken.toPandas().to_numpy(dtype="float64")  # about SPLIT_ROWS rows
    limits = [cuts(sample[:, i]) for i in range(d)]
    levels = np.array([len(c) for c in limits])
    plan = Plan(d, depth, row_share, rate, weight, seed)
    columns = max(1, int(np.ceil(column_share * d)))
    chunks = chunked(coded, d, limits, [*names, "label"], n).persist(StorageLevel.MEMORY_AND_DISK)
    made: list[Tree] = []
    stored = None
    shared_folder(spark)
    try:
        for number in range(trees):
            if number:
                before, last, step = chunks, made[-1], (1.0 if number == 1 else rate)

                def advance(chunk: dict, last: Tree = last, step: float = step) -> dict:
                    return chunk | {"out": chunk["out"] + step * leaf_values(chunk["bins"], last)}

                chunks = before.map(advance).persist(StorageLevel.MEMORY_AND_DISK)
                if number % CHECKPOINT_TREES == 0:
                    chunks.checkpoint()
            made.append(grow(chunks, plan, number, levels, columns))
            if number:
                before.unpersist()
                if number % CHECKPOINT_TREES == 0:
                    stored, old = chunks.getCheckpointFile(), stored
                    if stored:
                        remove_at_exit(spark, stored)
                    if old:
                        _delete(spark, old)
    finally:
        chunks.unpersist()
        if stored:
            _delete(spark, stored)
    return made, limits


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def library_model(spark: SparkSession, learner: GBTClassifier, trees: list[Tree], limits: list[np.ndarray], rate: float) -> GBTClassificationModel:
    """The trees as a model of MLlib, through the files it is saved in: a model of one small tree lends its form."""
    folder = f"{shared_folder(spark)}/boosted-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    few = spark.createDataFrame([(Vectors.dense(np.full(len(limits), v)), v, 1.0) for v in (0.0, 1.0)], ["features", "label", "weight"])
    form = learner.copy({learner.maxIter: 1, learner.maxDepth: 1}).fit(few.coalesce(1))
    form.write().save(f"{folder}/form")
    about = json.loads(spark.read.text(f"{folder}/form/metadata").first()["value"])
    about["numTrees"] = len(trees)
    about["paramMap"] |= {"maxIter": learner.getMaxIter(), "maxDepth": learner.getMaxDepth()}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{folder}/model/metadata")
    each = json.loads(spark.read.parquet(f"{folder}/form/treesMetadata").first()["_2"])
    each["paramMap"] |= {"maxDepth": learner.getMaxDepth()}
    spark.createDataFrame([(t, json.dumps(each | {"uid": f"{each['uid']}_{t}"}), rate if t else 1.0) for t in range(len(trees))],
                          "_1 int, _2 string, _3 double").write.parquet(f"{folder}/model/treesMetadata")
    rows = []
    for t, tree in enumerate(trees):
        for i, value in enumerate(tree.value().tolist()):
            f, inner = tree.feature[i], tree.feature[i] >= 0
            split = (f, [float(limits[f][tree.bin[i]])], -1) if inner else (-1, [], -1)
            rows.append((t, (i, value, 0.0, [tree.cover[i], tree.sum[i], 0.0], tree.rows[i], tree.gain[i] if inner else -1.0, tree.left[i], tree.right[i], split)))
    schema = spark.read.parquet(f"{folder}/form/data").schema
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/model/data")
    return GBTClassificationModel.load(f"{folder}/model")
