"""Tree ensembles as one node table, and their Shapley values in polynomial time.

The value of a feature set S for a record is the ensemble's output when features outside S are averaged over the training
rows: a split on such a feature is followed both ways, weighted by the rows that went there. A leaf then contributes, per
distinct feature i of its path, value * (o_i - r_i) * integral over t in [0, 1] of the product over the other features j of
(r_j (1 - t) + o_j t), where o is 1 if the record agrees with the path and r is the share of training rows that do. The
integral weighs feature sets as Shapley does, and Gauss-Legendre nodes give it exactly, so a leaf costs its depth squared
instead of two to the power of the features.

Whether a record agrees is all that a leaf asks of it, so the values of a whole subtree hang on a few yes-or-no answers. ``PathTables``
holds them for every combination of answers, summed over the leaves below; a record then costs a look-up per subtree and feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

BLOCK_NUMBERS = 4_000_000  # numbers of one intermediate array


@dataclass
class PathGroup:
    """Leaves whose paths ask about equally many distinct features: per leaf and feature the interval (low, high] and the share."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


@dataclass
class TreeTable:
    """Nodes of all trees end to end; ``left`` and ``right`` are row numbers, a leaf has feature -1.

    A record goes left where its feature is at most ``split``. ``cover`` is the (weighted) number of training rows at a node.
    """

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    roots: np.ndarray

    @classmethod
    def of(cls, nodes: pd.DataFrame, weights: np.ndarray) -> TreeTable:
        """From rows (tree, node, feature, split, left, right, value, cover), nodes numbered within their tree, and a weight per tree."""
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        width = int(nodes["node"].max()) + 1
        place = np.full((int(nodes["tree"].max()) + 1) * width, -1)
        at = (nodes["tree"] * width + nodes["node"]).to_numpy()
        place[at] = np.arange(len(nodes))
        leaf = (nodes["feature"] < 0).to_numpy()
        child = lambda c: np.where(leaf, -1, place[np.where(leaf, 0, nodes["tree"] * width + nodes[c])])
        tree = nodes["tree"].to_numpy()
        return cls(
            nodes["feature"].to_numpy("int64"), nodes["split"].to_numpy("float64"), child("left"), child("right"),
            np.where(leaf, nodes["value"], 0.0) * np.asarray(weights, "float64")[tree], nodes["cover"].to_numpy("float64"),
            np.flatnonzero(nodes["node"].to_numpy() == 0),
        )

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values that each row reaches."""
        out = np.zeros(len(x))
        leaf = self.feature < 0
        own = np.arange(len(self.feature))
        child = np.stack([np.where(leaf, own, self.right), np.where(leaf, own, self.left)], axis=1).ravel()  # a leaf is its own child
        feature = np.maximum(self.feature, 0)
        block = max(1, BLOCK_NUMBERS // (16 * max(1, len(self.roots))))
        for start in range(0, len(x), block):
            part = np.ascontiguousarray(x[start : start + block])
            row = (np.arange(len(part)) * part.shape[1])[:, None]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            while not leaf.take(at).all():
                goes_left = part.take(row + feature.take(at)) <= self.split.take(at)
                at = child.take(2 * at + goes_left)
            out[start : start + block] = self.value.take(at).sum(axis=1)
        return out

    def paths(self) -> list[PathGroup]:
        """Every leaf's path with one entry per distinct feature, grouped by their number; leaves of empty branches are left out."""
        found: dict[int, list] = {}
        for root in self.roots.tolist():
            todo = [(root, {})]
            while todo:
                node, path = todo.pop()
                feature = int(self.feature[node])
                if feature < 0:
                    found.setdefault(len(path), []).append((path, self.value[node]))
                    continue
                low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
                split, cover = self.split[node], self.cover[node]
                for child, a, b in ((self.left[node], low, min(high, split)), (self.right[node], max(low, split), high)):
                    if self.cover[child] > 0:
                        todo.append((int(child), path | {feature: (a, b, share * self.cover[child] / cover)}))
        return path_groups(found)


def path_groups(found: dict[int, list]) -> list[PathGroup]:
    """From (path, value) of leaves by the number of distinct features; a path is feature: (low, high, share)."""
    groups = []
    for d, leaves in sorted(found.items()):
        cells = np.array([[(f, *c) for f, c in sorted(path.items())] for path, _ in leaves], dtype="float64").reshape(len(leaves), d, 4)
        groups.append(PathGroup(cells[..., 0].astype("int64"), cells[..., 1], cells[..., 2], cells[..., 3], np.array([v for _, v in leaves])))
    return groups


def mean_output(groups: list[PathGroup]) -> float:
    """The ensemble's mean over its training rows, the value of the empty feature set."""
    return float(sum((g.value * g.share.prod(axis=1)).sum() for g in groups))


def path_values(x: np.ndarray, groups: list[PathGroup]) -> np.ndarray:
    """Shapley values of every row, (rows, features); they add up to the raw output less ``mean_output``."""
    out = np.zeros(x.shape)
    for g in groups:
        leaves, d = g.feature.shape
        if not d:
            continue
        points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        some = min(leaves, max(1, BLOCK_NUMBERS // (64 * d)))
        for first in range(0, leaves, some):
            part = slice(first, first + some)
            feature, share, value = g.feature[part], g.share[part], g.value[part, None]
            to_feature = np.zeros((feature.size, x.shape[1]))
            to_feature[np.arange(feature.size), feature.ravel()] = 1.0
            rows = max(1, BLOCK_NUMBERS // feature.size)
            for start in range(0, len(x), rows):
                block = x[start : start + rows]
                held = block[:, feature]
                agrees = ((held > g.low[part]) & (held <= g.high[part])).astype("float64")
                weighed = np.zeros(agrees.shape)
                for t, w in zip(points, weights):
                    each = share * (1 - t) + agrees * t
                    weighed += w * each.prod(axis=2, keepdims=True) / each
                out[start : start + rows] += (value * (agrees - share) * weighed).reshape(len(block), -1) @ to_feature
    return out


CELL_BITS = 7  # answers that a subtree's table is made for; it has two to their power of rows, and they fit into a byte
LEAVES_AT_ONCE = 256
ROWS_AT_ONCE = 4096


def answer_values(agrees: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley values of leaves, (leaves, features of the path, answers), from whether each feature agrees under each combination of answers."""
    d = agrees.shape[1]
    points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    agrees, share = agrees.astype("float64"), share[..., None]
    weighed = np.zeros(agrees.shape)
    for t, w in zip((points + 1) / 2, weights / 2):
        each = share * (1 - t) + agrees * t
        weighed += w * each.prod(axis=1, keepdims=True) / each
    return value[:, None, None] * (agrees - share) * weighed


class PathTables:
    """The Shapley values of an ensemble, ready to be looked up.

    A cell is a subtree with at most ``CELL_BITS`` questions: one per distinct feature above it (is the record in the interval of the path) and one
    per split in it. Its table has a row per feature and a number per combination of answers. Leaves below more features than
    that have no table; ``path_values`` works them out.
    """

    def __init__(self, table: TreeTable):
        self.cells: list[tuple[list[tuple[int, float, float]], list[int], np.ndarray]] = []
        self._waiting: dict[tuple[int, int], list] = {}
        inner = np.zeros(len(table.feature), dtype="int64")  # splits at and below a node
        below, level = [], table.roots
        while len(level):
            below.append(level)
            level = level[table.feature[level] >= 0]
            level = np.concatenate([table.left[level], table.right[level]])
        for nodes in reversed(below):
            splits = nodes[table.feature[nodes] >= 0]
            inner[splits] = 1 + inner[table.left[splits]] + inner[table.right[splits]]
        many: dict[int, list] = {}
        for root in table.roots.tolist():
            todo: list[tuple[int, dict]] = [(root, {})]
            while todo:
                node, path = todo.pop()
                feature = int(table.feature[node])
                if len(path) + inner[node] <= CELL_BITS:
                    self._cell(table, node, path)
                elif feature < 0:
                    many.setdefault(len(path), []).append((path, table.value[node]))
                else:
                    low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
                    split, cover = float(table.split[node]), table.cover[node]
                    for child, a, b in ((table.left[node], low, min(high, split)), (table.right[node], max(low, split), high)):
                        if table.cover[child] > 0:
                            todo.append((int(child), path | {feature: (a, b, share * table.cover[child] / cover)}))
        for key in list(self._waiting):
            self._fill(key)
        self.many = path_groups(many)

    def _cell(self, table: TreeTable, node: int, path: dict) -> None:
        """The questions of a subtree, and its leaves put down to be worked out."""
        asked, leaves = [(f, low, high) for f, (low, high, _) in path.items()], []
        todo = [(node, {f: ([(i, True)], path[f][2]) for i, f in enumerate(path)})]
        while todo:
            at, known = todo.pop()
            feature = int(table.feature[at])
            if feature < 0:
                leaves.append((known, float(table.value[at])))
                continue
            held, share = known.get(feature, ([], 1.0))
            question = len(asked)
            asked.append((feature, -np.inf, float(table.split[at])))
            for child, answer in ((table.left[at], True), (table.right[at], False)):
                if table.cover[child] > 0:
                    todo.append((int(child), known | {feature: (held + [(question, answer)], share * table.cover[child] / table.cover[at])}))
        if not asked:
            return
        features = sorted({f for f, _, _ in asked})
        values = np.zeros((len(features), 1 << len(asked)))
        self.cells.append((asked, features, values))
        answers = (np.arange(1 << len(asked)) >> np.arange(len(asked))[:, None] & 1).astype(bool)
        for known, value in leaves:
            agrees = np.ones((len(known), answers.shape[1]), dtype=bool)
            for i, (held, _) in enumerate(known.values()):
                for question, answer in held:
                    agrees[i] &= answers[question] if answer else ~answers[question]
            key = len(known), len(asked)
            self._waiting.setdefault(key, []).append((values, [features.index(f) for f in known], agrees, [s for _, s in known.values()], value))
            if len(self._waiting[key]) >= LEAVES_AT_ONCE:
                self._fill(key)

    def _fill(self, key: tuple[int, int]) -> None:
        waiting = self._waiting.pop(key)
        if not key[0]:
            return
        found = answer_values(np.stack([w[2] for w in waiting]), np.array([w[3] for w in waiting]), np.array([w[4] for w in waiting]))
        for (values, places, *_), each in zip(waiting, found):
            values[places] += each  # the features of a path are distinct

    def values(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of every row, (rows, features); like ``TreeTable.raw``, what is not at most a split goes right."""
        out = np.zeros(x.shape)
        for start in range(0, len(x), ROWS_AT_ONCE):
            part = np.ascontiguousarray(x[start : start + ROWS_AT_ONCE].T)
            sums, found = np.zeros(part.shape), np.empty(part.shape[1])
            for asked, features, values in self.cells:
                answers = np.zeros(part.shape[1], dtype=np.uint8)
                for i, (feature, low, high) in enumerate(asked):
                    if high < np.inf:
                        yes = part[feature] <= high
                        if low > -np.inf:
                            yes &= ~(part[feature] <= low)
                    else:
                        yes = ~(part[feature] <= low)
                    answers |= yes.view(np.uint8) << np.uint8(i)
                at = answers.astype(np.intp)
                for feature, row in zip(features, values):
                    np.take(row, at, out=found, mode="clip")
                    sums[feature] += found
            out[start : start + ROWS_AT_ONCE] = sums.T
        return out + path_values(x, self.many) if self.many else out
