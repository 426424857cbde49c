"""Quality rules: counts per text, hard limits on them, and a classifier for what is left.

The classifier is a logistic regression on hashed words, word pairs and character n-grams (byte windows of 3 and 5),
each kind as shares of its own count. It is fitted on a bounded sample of labelled documents (``TRAIN_DOCUMENTS``, half
of each class where there are enough, picked by hash), calibrated to probabilities on a part of the sample held out
from the fit and for the classes' shares among all labels, and applied in Arrow batches against a fixed threshold.

Defined cases: a null or empty text has no words and fails the base rules; a document labelled several times has its
lowest label; null labels and labels of unknown documents are left out; without documents of both classes the verdict of
the classifier is to keep; repeated documents are judged alike; other columns are passed through by
``good_documents`` and ignored by ``quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents
from .texts import NOT_SPACE, SMALL_SLICE_BYTES, Prefix, batch_slices, group_windows, mix, per_text, runs, text_bytes, words_of

TRAIN_DOCUMENTS = 3000
HELD_OUT = 3  # one in so many sampled documents is for the calibration
BUCKET_BITS = 14
BYTE_GRAMS = (3, 5)
KEEP_ABOVE = 0.5
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


class Texts:
    """The texts of one slice with their words."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        self.prefix = Prefix(self.data)
        self.starts, self.ends, self.first = words_of(self.data, self.offsets, NOT_SPACE)
        self.words = self.prefix.between(self.starts, self.ends)
        self.n = len(column)

    def totals(self, flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    def counts(self) -> dict[str, np.ndarray]:
        """The base counts, one number per text."""
        first_bytes = NOT_SPACE[self.data] & ((self.data & 0xC0) != 0x80)
        return {
            "n_words": np.diff(self.first),
            "word_chars": self.totals(first_bytes, self.offsets),
            "n_symbols": self.totals(_SYMBOLS[self.data], self.offsets),
            "n_dup_lines": self._repeated_lines(),
            "n_repeat_words": self._repeated_words(),
        }

    def _repeated_lines(self) -> np.ndarray:
        starts, ends = runs(self.data != 0x0A, self.offsets)  # lines without a byte have no word either
        filled = np.concatenate([[0], np.cumsum(NOT_SPACE[self.data])])
        with_word = filled[ends] > filled[starts]
        starts, ends = starts[with_word], ends[with_word]
        text = np.searchsorted(self.offsets, starts, side="right") - 1
        keys = mix(self.prefix.between(starts, ends) ^ mix(text.astype(np.uint64)))
        again = np.ones(len(keys), bool)
        again[np.unique(keys, return_index=True)[1]] = False
        return np.bincount(text[again], minlength=self.n)

    def _repeated_words(self) -> np.ndarray:
        keys, at = group_windows(self.words, self.first, REPEAT_WINDOW)
        keys = mix(keys ^ mix(per_text(self.first, at).astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        found = np.zeros(len(keys), bool)
        found[order[1:][same]] = found[order[:-1][same]] = True
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, at[found], 1)
        np.add.at(edge, at[found] + REPEAT_WINDOW, -1)
        return self.totals(np.cumsum(edge[:-1]) > 0, self.first)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each kind of feature: the bucket of every occurrence, and where those of each text begin."""
        shift = np.uint64(64 - BUCKET_BITS)
        yield mix(self.words + np.uint64(1)) >> shift, self.first
        pairs, at = group_windows(self.words, self.first, 2)
        yield mix(pairs + np.uint64(2)) >> shift, np.searchsorted(at, self.first)
        for width in BYTE_GRAMS:
            n = max(0, len(self.data) - width + 1)
            inside = np.arange(n) + width <= np.repeat(self.offsets[1:], np.diff(self.offsets))[:n]
            places = np.flatnonzero(inside)
            yield mix(self.prefix.windows(width)[places] + np.uint64(width)) >> shift, np.searchsorted(places, self.offsets)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(self.n)
        for buckets, begin in self.grams():
            sums = np.concatenate([[0.0], np.cumsum(weights[buckets.astype(np.int64)])])
            total += (sums[begin[1:]] - sums[begin[:-1]]) / np.maximum(1, np.diff(begin))
        return total

    def features(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values of one text."""
        values = np.zeros(1 << BUCKET_BITS)
        for buckets, begin in self._all_grams:
            mine = buckets[begin[i] : begin[i + 1]].astype(np.int64)
            values += np.bincount(mine, minlength=len(values)) / max(1, len(mine))
        used = np.flatnonzero(values)
        return used.astype(np.int32), values[used].astype(np.float32)

    @property
    def _all_grams(self):
        if not hasattr(self, "_stored"):
            self._stored = list(self.grams())
        return self._stored


@dataclass
class Model:
    """Weights per bucket and the two numbers that turn a score into a probability of good quality."""

    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, texts: Texts) -> np.ndarray:
        return _sigmoid(self.slope * texts.scores(self.weights) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


FIT_BLOCK = 100  # documents whose features are in double precision at a time


def _logistic(columns: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, steps: int = 120, ridge: float = 1e-3):
    """Logistic regression by accelerated gradient steps on columns scaled to equal size; sparse input, row by row.

    The features are kept as they came, in blocks of rows, so that only one block is widened at a time.
    """
    n, width = len(y), 1 << BUCKET_BITS
    blocks = []
    for a in range(0, n, FIT_BLOCK):
        part = slice(a, min(a + FIT_BLOCK, n))
        begin = np.concatenate([[0], np.cumsum([len(c) for c in columns[part]])])
        blocks.append((part, begin, np.concatenate(columns[part]), np.concatenate(values[part])))
    columns.clear()
    values.clear()

    def times(w: np.ndarray) -> np.ndarray:
        """The matrix times a vector of weights."""
        out = np.zeros(n)
        for part, begin, c, v in blocks:
            sums = np.concatenate([[0.0], np.cumsum(v * w[c])])
            out[part] = sums[begin[1:]] - sums[begin[:-1]]
        return out

    def back(r: np.ndarray, power: int = 1) -> np.ndarray:
        """A vector over the rows times the matrix."""
        out = np.zeros(width)
        for part, begin, c, v in blocks:
            out += np.bincount(c, v.astype(np.float64) ** power * np.repeat(r[part], np.diff(begin)), width)
        return out

    scale = 1 / np.sqrt(back(np.ones(n), 2) / n + 1e-8)
    # The largest eigenvalue of the squared matrix by power steps gives the step size.
    v = np.ones(width)
    for _ in range(8):
        v = scale * back(times(scale * v))
        norm = np.linalg.norm(v)
        v /= norm
    rate = 1 / (0.25 * norm / n + 0.25 + ridge)
    w, bias, ahead, ahead_bias = np.zeros(width), 0.0, np.zeros(width), 0.0
    for k in range(steps):
        error = _sigmoid(times(scale * ahead) + ahead_bias) - y
        new = ahead - rate * (scale * back(error) / n + ridge * ahead)
        new_bias = ahead_bias - rate * error.mean()
        ahead, ahead_bias = new + k / (k + 3) * (new - w), new_bias + k / (k + 3) * (new_bias - bias)
        w, bias = new, new_bias
    return w * scale


def _calibrate(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-out scores, by Newton steps; labels are softened a little."""
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    middle, spread = scores.mean(), scores.std() + 1e-12
    x = np.stack([(scores - middle) / spread, np.ones(len(y))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ beta)
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (goal - p) - 1e-3 * beta)
    return float(beta[0] / spread), float(beta[1] - beta[0] * middle / spread)


def train(docs: DataFrame, labels: DataFrame, size: int = TRAIN_DOCUMENTS) -> Model | None:
    """Fit on at most ``size`` labelled documents; None without documents of both classes."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not (shares.get(0) and shares.get(1)):
        return None
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size // 2)
        picked = part if picked is None else picked.unionByName(part)
    sample = F.broadcast(picked.withColumnRenamed("doc_id", "_labelled"))  # at most ``size`` rows of two numbers
    rows = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_labelled")).select("doc_id", "y", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "text", SMALL_SLICE_BYTES):
                texts = Texts(part.column("text"))
                found = [texts.features(i) for i in range(texts.n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("y").cast(pa.int32()), pa.array([f[0].tobytes() for f in found], pa.binary()),
                     pa.array([f[1].tobytes() for f in found], pa.binary())], ["doc_id", "y", "buckets", "amounts"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _fitted([b for b in batches if b.num_rows], shares)
        if model is not None:
            yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "slope": [model.slope], "shift": [model.shift]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    sampled = rows.mapInArrow(features, f"doc_id {kind}, y int, buckets binary, amounts binary").repartition(1)
    found = sampled.mapInArrow(fit, "weights binary, slope double, shift double").collect()  # one row: the model
    return Model(np.frombuffer(found[0]["weights"], np.float64), found[0]["slope"], found[0]["shift"]) if found else None


def _fitted(batches: list[pa.RecordBatch], shares: dict) -> Model | None:
    """The model of a sample's features; they lie in one task, whose size the sample's bound sets."""
    if not batches:
        return None
    got = pa.Table.from_batches(batches)
    order = pc.sort_indices(got.column("doc_id")).to_pylist()  # the rows themselves are not copied
    y = np.array(got.column("y").to_pylist(), np.float64)[order]
    if len(set(y)) < 2:
        return None
    buckets, amounts = list(got.column("buckets")), list(got.column("amounts"))
    columns = [np.frombuffer(buckets[i].as_buffer(), np.int32) for i in order]
    values = [np.frombuffer(amounts[i].as_buffer(), np.float32) for i in order]
    held = np.zeros(len(y), bool)
    for label in (0, 1):  # one in HELD_OUT of each class, in the order of the ids
        held[np.flatnonzero(y == label)[HELD_OUT - 1 :: HELD_OUT]] = True
    fit = np.flatnonzero(~held)
    weights = _logistic([columns[i] for i in fit], [values[i] for i in fit], y[fit])
    judge = np.flatnonzero(held) if len(set(y[held])) == 2 else np.arange(len(y))
    scores = np.array([weights[columns[i]] @ values[i] for i in judge])
    slope, shift = _calibrate(scores, y[judge])
    odds = (shares[1] / shares[0]) / (y[judge].sum() / (1 - y[judge]).sum())
    return Model(weights, slope, shift + float(np.log(odds)))


def _judged(column: pa.Array, model: Model | None, keep_above: float) -> dict[str, np.ndarray]:
    texts = Texts(column)
    counts = texts.counts()
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
    probability = model.probability(texts) if model else np.ones(texts.n)
    return counts | {"base_failed": failed, "kept": ~failed & (probability >= keep_above), "p_good": probability}


def quality(docs: DataFrame, labels: DataFrame, keep_above: float = KEEP_ABOVE, train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """Per document: base counts, the base rules' verdict, the classifier's probability, and whether it is kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_documents))  # 1 << BUCKET_BITS weights

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "text", SMALL_SLICE_BYTES):
                found = _judged(part.column("text"), model.value, keep_above)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        judge, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean, p_good double")


def good_documents(docs: DataFrame, labels: DataFrame, keep_above: float = KEEP_ABOVE, train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_documents))
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, place, SMALL_SLICE_BYTES):
                yield part.filter(pa.array(_judged(part.column(place), model.value, keep_above)["kept"]))

    return docs.mapInArrow(keep, T.StructType(docs.schema.fields))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(documents(spark, folder), documents(spark, folder, "labels")).drop("p_good")
