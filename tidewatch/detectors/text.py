"""Log text detector: hashed term weights and a class-weighted logistic regression, over whole messages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.detectors.base import Detector
from tidewatch.operators.profile import class_weights
from tidewatch.schemas import LOG_THRESHOLD


def tokens(message: Column) -> Column:
    """Lower-case words; addresses and numbers become one token each, as their values say little."""
    masked = F.regexp_replace(F.coalesce(message, F.lit("")), r"\b\d{1,3}(\.\d{1,3}){3}\b", " ipaddr ")
    masked = F.regexp_replace(masked, r"\b\d+\b", " num ")
    return F.filter(F.split(F.lower(masked), r"[^\p{L}\p{N}_=]+"), lambda t: t != "")


class LogTextDetector(Detector):
    kind = "text"

    def __init__(self, terms: int = 1 << 16, iterations: int = 50):
        super().__init__(["message"])
        self.terms, self.iterations = terms, iterations
        self.threshold = LOG_THRESHOLD
        self.model: PipelineModel | None = None

    def hashed(self, df: DataFrame, text: str = "message", name: str = "_tf") -> DataFrame:
        """Add the term counts of a text. Done before a join, the counts move instead of the text, and it is split once."""
        counted = HashingTF(inputCol="_tokens", outputCol=name, numFeatures=self.terms).transform(df.withColumn("_tokens", tokens(F.col(text))))
        return counted.drop("_tokens")

    def fit(self, train: DataFrame, label: str = "is_anomaly") -> LogTextDetector:
        """Learn from labelled rows with a message, or with the counts ``_tf`` that ``hashed`` made of it."""
        known = train.where(F.col(label).isNotNull())
        weight = class_weights(known, label).first()["anomaly_weight"]
        y = F.col(label).cast("double")
        rows = (known if "_tf" in train.columns else self.hashed(known)).select(
            "_tf", y.alias("label"), F.when(y == 1, F.lit(float(weight or 1.0))).otherwise(1.0).alias("_weight"))
        hashing = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=self.terms)
        learner = LogisticRegression(
            featuresCol="_tfidf", labelCol="label", weightCol="_weight", maxIter=self.iterations, regParam=0.01,
            probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred",
        )
        counted = rows.persist(StorageLevel.MEMORY_AND_DISK)  # split texts once
        try:
            weighting = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted)
            self.model = PipelineModel([hashing, weighting, learner.fit(weighting.transform(counted))])
        finally:
            counted.unpersist()
        return self

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        if "_tf" in df.columns:
            coded = PipelineModel(self.model.stages[1:]).transform(df)
        else:
            coded = self.model.transform(df.withColumn("_tokens", tokens(F.col("message"))))
        return coded.withColumn(name, F.get(vector_to_array("_prob"), 1)).drop(
            "_tokens", "_tf", "_tfidf", "_prob", "_raw", "_pred"
        )

    def term_attribution(self, df: DataFrame, name: str = "attribution", top: int = 10, raw: str | None = None, base: str | None = None) -> DataFrame:
        """Add the terms of each message that moved its score most, with their share of the log-odds.

        The model is linear, so a term's value is its weight times its share of the message's vector, and the values of all terms
        and the intercept (``base``) add up to the log-odds (``raw``). Terms of one bucket share its value by their counts.
        Words are read off the message itself, so there is no dictionary that grows with the corpus; what is broadcast
        are the weights, one number per bucket.
        """
        weights = self.model.stages[2].coefficients.toArray() * self.model.stages[1].idf.toArray()
        held = df.sparkSession.sparkContext.broadcast(weights)
        buckets, intercept = self.terms, float(self.model.stages[2].intercept)

        entry = pa.struct([("feature", pa.string()), ("value", pa.float64())])

        @F.arrow_udf("struct<parts: array<struct<feature: string, value: double>>, raw: double>")
        def explain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            place: dict[str, int] = {}

            def some(texts: pa.Array) -> pa.Array:
                """The entries of a few texts; as Arrow columns they take the bytes of their words and a number each."""
                ends, terms, shares, sums = [0], [], [], []
                for words in texts.to_pylist():
                    counts = Counter(words if words is not None else ())
                    if len(place) > MOST_PLACES:
                        place.clear()
                    for w in counts:
                        if w not in place:
                            place[w] = term_bucket(w, buckets)
                    values = {w: float(held.value[place[w]]) * n for w, n in counts.items()}
                    sums.append(intercept + sum(values.values()))
                    for w, v in sorted(values.items(), key=lambda x: (-abs(x[1]), x[0]))[:top]:
                        terms.append(w)
                        shares.append(v)
                    ends.append(len(terms))
                entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(shares, pa.float64())], fields=list(entry))
                parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
                return pa.StructArray.from_arrays([parts, pa.array(sums, pa.float64())], ["parts", "raw"])

            for batch in batches:
                yield pa.concat_arrays([some(batch.slice(at, TEXTS_AT_ONCE)) for at in range(0, max(1, len(batch)), TEXTS_AT_ONCE)])

        found = df.withColumn("_phi", explain(tokens(F.col("message"))))
        found = found.withColumn(name, F.col("_phi.parts"))
        if raw:
            found = found.withColumn(raw, F.col("_phi.raw"))
        if base:
            found = found.withColumn(base, F.lit(intercept))
        return found.drop("_phi")


MOST_PLACES = 200_000  # words that a worker remembers the bucket of
TEXTS_AT_ONCE = 64  # texts whose words are Python objects at the same time


def term_bucket(term: str, buckets: int) -> int:
    """The bucket that MLlib's ``HashingTF`` gives a term: MurmurHash3 with 32 bits of its UTF-8 bytes, seed 42."""
    mask, data = 0xFFFFFFFF, term.encode()
    rotate = lambda x, r: (x << r | x >> (32 - r)) & mask
    h, whole = 42, len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = rotate(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (rotate(h ^ k, 13) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= rotate(int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets
