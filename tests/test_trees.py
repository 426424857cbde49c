from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.detectors.boosted import BoostedTrees
from tidewatch.detectors.iforest import IsolationForest
from tidewatch.detectors import boosting, trees
from tidewatch.detectors.trees import PathTables, TreeTable, mean_output, path_values
from tidewatch.operators.shapley import tree_shapley
from tidewatch.schemas import METRIC_FEATURES
from tidewatch.sources import views


def random_trees(rng, trees: int, depth: int, features: int) -> pd.DataFrame:
    """Trees whose covers are those of random training rows, with features asked about more than once on a path."""
    rows = []
    for tree in range(trees):
        points, todo, made = rng.normal(size=(200, features)), [(0, np.arange(200), 0)], 1
        while todo:
            node, at, level = todo.pop()
            if level >= depth or len(at) < 4 or rng.random() < 0.1:
                rows.append((tree, node, -1, 0.0, -1, -1, rng.normal(), len(at)))
                continue
            feature = int(rng.integers(features))
            split = float(np.median(points[at, feature]) + rng.normal() * 0.2)
            left = points[at, feature] <= split
            rows.append((tree, node, feature, split, made, made + 1, 0.0, len(at)))
            todo += [(made, at[left], level + 1), (made + 1, at[~left], level + 1)]
            made += 2
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "value", "cover"])


def set_value(table: TreeTable, x: np.ndarray, known: set) -> float:
    """Output with the features outside ``known`` averaged by cover, walking every tree."""
    def walk(node: int) -> float:
        f = int(table.feature[node])
        if f < 0:
            return table.value[node]
        left, right = int(table.left[node]), int(table.right[node])
        if f in known:
            return walk(left if x[f] <= table.split[node] else right)
        return sum(table.cover[c] * walk(c) for c in (left, right) if table.cover[c]) / table.cover[node]

    return sum(walk(int(r)) for r in table.roots)


@pytest.mark.parametrize("seed,features,depth", [(1, 3, 5), (2, 5, 4), (3, 6, 6), (4, 1, 3)])
def test_path_values_equal_all_feature_sets(seed, features, depth):
    rng = np.random.default_rng(seed)
    table = TreeTable.of(random_trees(rng, 4, depth, features), rng.normal(size=4))
    x = rng.normal(size=(6, features))
    got, base = path_values(x, table.paths()), mean_output(table.paths())
    for row, values in zip(x, got):
        for i in range(features):
            others = [j for j in range(features) if j != i]
            want = sum(
                factorial(k) * factorial(features - k - 1) / factorial(features) * (set_value(table, row, {*s, i}) - set_value(table, row, set(s)))
                for k in range(features) for s in combinations(others, k)
            )
            assert values[i] == pytest.approx(want, abs=1e-10)
    assert base == pytest.approx(set_value(table, x[0], set()))
    assert np.allclose(got.sum(axis=1), table.raw(x) - base)


@pytest.mark.parametrize("seed,features,depth,bits", [(5, 3, 5, 7), (6, 6, 6, 7), (7, 12, 10, 7), (8, 12, 7, 3), (9, 1, 4, 2)])
def test_looked_up_values_are_those_of_the_paths(monkeypatch, seed, features, depth, bits):
    """Also of paths with more features than a table has answers, and of a record on either side of every split."""
    monkeypatch.setattr(trees, "CELL_BITS", bits)
    monkeypatch.setattr(trees, "LEAVES_AT_ONCE", 5)
    monkeypatch.setattr(trees, "ROWS_AT_ONCE", 7)
    rng = np.random.default_rng(seed)
    table = TreeTable.of(random_trees(rng, 6, depth, features), rng.normal(size=6))
    x = np.concatenate([rng.normal(size=(20, features)), rng.choice(table.split, size=(20, features))])
    tables = PathTables(table)
    assert bool(tables.many) == (bits < features and bits < depth)
    assert np.allclose(tables.values(x), path_values(x, table.paths()), atol=1e-12)


def test_a_value_costs_less_than_every_leaf(monkeypatch):
    """Rows are looked up by subtree: no work per leaf and point of the quadrature is left for each of them."""
    rng = np.random.default_rng(10)
    table = TreeTable.of(random_trees(rng, 10, 6, 8), np.ones(10))
    tables, leaves = PathTables(table), sum(len(g.value) for g in table.paths())
    monkeypatch.setattr(trees, "answer_values", None)
    assert not tables.many and 3 * len(tables.cells) < leaves
    assert tables.values(rng.normal(size=(50, 8))).shape == (50, 8)


def test_missing_and_endless_numbers_go_where_the_trees_send_them():
    table = TreeTable.of(random_trees(np.random.default_rng(12), 3, 3, 2), np.ones(3))
    assert (table.cover > 0).all()
    x = np.array([[np.nan, 0.1], [np.inf, 0.1], [1e300, 0.1], [-np.inf, 0.1], [-1e300, 0.1]])
    got = PathTables(table).values(x)
    assert np.array_equal(got[0], got[2]) and np.array_equal(got[1], got[2]) and np.array_equal(got[3], got[4])
    assert np.allclose(got.sum(axis=1), table.raw(x) - mean_output(table.paths()))


def test_a_tree_that_is_one_leaf():
    nodes = pd.DataFrame([(0, 0, -1, 0.0, -1, -1, 2.5, 10)], columns=["tree", "node", "feature", "split", "left", "right", "value", "cover"])
    table = TreeTable.of(nodes, np.ones(1))
    assert path_values(np.zeros((2, 3)), table.paths()).tolist() == [[0, 0, 0], [0, 0, 0]]
    assert PathTables(table).values(np.zeros((2, 3))).tolist() == [[0, 0, 0], [0, 0, 0]]
    assert mean_output(table.paths()) == 2.5 and table.raw(np.zeros((2, 3))).tolist() == [2.5, 2.5]


@pytest.fixture(scope="module")
def metrics(spark, folder):
    return views.metrics(spark, folder).cache()


def test_boosted_raw_output_and_attribution(spark, metrics):
    detector = BoostedTrees(METRIC_FEATURES, trees=8, depth=4, rate=0.3).fit(metrics, "is_anomaly")
    scored = detector.score(metrics)
    found = tree_shapley(scored, detector, raw="raw", base="base").select(
        "score", "raw", "base", "attribution", F.aggregate("attribution", F.lit(0.0), lambda a, e: a + e["value"]).alias("sum"), *METRIC_FEATURES).collect()
    assert len(found) == metrics.count()
    x = np.array([[float(r[c] or 0) for c in METRIC_FEATURES] for r in found])
    assert np.allclose(detector.on_arrays()(x), [r["score"] for r in found])  # the node table scores as the library does
    assert np.allclose([r["sum"] for r in found], [r["raw"] - r["base"] for r in found], atol=1e-6)
    sizes = [[abs(e["value"]) for e in r["attribution"]] for r in found]
    assert all(s == sorted(s, reverse=True) and len(s) == len(METRIC_FEATURES) for s in sizes)


def test_forest_attribution(spark, metrics):
    detector = IsolationForest(METRIC_FEATURES, trees=20, sample=64).fit(metrics, "rec_id", None)
    found = tree_shapley(detector.score(metrics).limit(50), detector, raw="raw", base="base").select(
        "score", "raw", "base", F.aggregate("attribution", F.lit(0.0), lambda a, e: a + e["value"]).alias("sum")).collect()
    assert np.allclose([2.0 ** r["raw"] for r in found], [r["score"] for r in found])
    assert np.allclose([r["sum"] for r in found], [r["raw"] - r["base"] for r in found], atol=1e-6)


def test_scoring_leaves_the_fitted_model_alone(metrics):
    detector = BoostedTrees(METRIC_FEATURES, trees=2, depth=2).fit(metrics, "is_anomaly")
    before = detector.model.getFeaturesCol()
    detector.score(metrics).count()
    assert detector.model.getFeaturesCol() == before


def grown(rng, features: int, depth: int) -> boosting.Tree:
    tree, level = boosting.Tree(), [0]
    tree.add(1, 1.0, 0.0)
    for _ in range(depth):
        below = []
        for node in level:
            if node and rng.random() < 0.15:
                continue
            tree.feature[node], tree.bin[node] = int(rng.integers(features)), int(rng.integers(1, 31))
            tree.left[node], tree.right[node] = (tree.add(1, 1.0, float(rng.normal())) for _ in range(2))
            below += [tree.left[node], tree.right[node]]
        level = below
    return tree


@pytest.mark.parametrize("depth", [0, 1, 6, 10])
def test_marks_are_the_nodes_that_rows_come_to(depth):
    rng = np.random.default_rng(depth)
    tree, bins = grown(rng, 5, depth), rng.integers(0, 32, (5, 3000)).astype(np.uint8)
    came = np.zeros((bins.shape[1], len(tree.feature)), dtype=bool)
    last = np.zeros(bins.shape[1], dtype=int)
    for i in range(bins.shape[1]):
        node = 0
        came[i, 0] = True
        while tree.feature[node] >= 0:
            node = tree.left[node] if bins[tree.feature[node], i] <= tree.bin[node] else tree.right[node]
            came[i, node] = True
        last[i] = node
    assert np.array_equal(boosting.leaf_values(bins, tree), tree.value()[last])
    wanted = {node: i + 1 for i, node in enumerate(n for n in range(len(tree.feature)) if tree.feature[n] < 0 and n % 2)}
    assert boosting.marked(bins, tree, wanted).tolist() == [wanted.get(n, 0) for n in last]
    assert np.array_equal(boosting.marked(bins, tree, {len(tree.feature) - 1: 7}), 7 * came[:, -1])


def test_rows_are_compared_only_on_the_way_to_a_wanted_node():
    """A chunk is compared once per split above a wanted node, not looked up row by row from the root of the tree."""
    tree = grown(np.random.default_rng(1), 5, 6)
    looked = []

    class Bins(list):
        shape = (5, 40)

        def __getitem__(self, feature):
            looked.append(feature)
            return np.full(40, 3, dtype=np.uint8)

    wanted, above = len(tree.feature) - 1, 0
    node = wanted
    while node:
        node = next(n for n in range(node) if node in (tree.left[n], tree.right[n]))
        above += 1
    boosting.marked(Bins(), tree, {wanted: 1})
    assert len(looked) == above
