"""Removal of recurring lines by a log-template tree.

Every line is parsed to a leaf of a tree of fixed depth: the number of its words, then its first ``DEPTH`` words, words
with a digit being variable from the start. Inside a leaf, words that vary become variable as well: at each place the word
that most documents have is constant if at least half of them have it. Lines that agree with the leaf's constants on
at least ``SIMILARITY`` of their words have the leaf's template; any other line is a template of its own. Templates
that occur in at least ``MIN_DOCUMENTS`` documents recur, and their lines are dropped from every document.

Counts per line and leaf are summed before they move. Words are only counted by place in leaves that many documents
share and that hold several different lines, and there once per different line.

Defined cases: lines are the parts between line feeds that hold a word, others are left alone; a null or empty text
has none; rows equal in id and text are one document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, only, ordered_rows
from .texts import NOT_SPACE, Prefix, batch_slices, mix, runs, text_bytes, words_of

DEPTH, SIMILARITY, MIN_DOCUMENTS = 3, 0.7, 5
VARIABLE = 0  # stands for a word that varies
BROADCAST_LEAVES = 1_000_000


class Lines:
    """The lines of one slice of texts, with leaf and hash of each."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        starts, ends, _ = words_of(self.data, self.offsets, NOT_SPACE)
        prefix = Prefix(self.data)
        digit = np.concatenate([[0], np.cumsum((self.data >= 0x30) & (self.data <= 0x39))])
        self.words = np.where(digit[ends] > digit[starts], np.uint64(VARIABLE), prefix.between(starts, ends) | np.uint64(1))
        begin, end = runs(self.data != 0x0A, self.offsets)
        first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
        filled = last > first
        self.begin, self.end, self.first, self.last = begin[filled], end[filled], first[filled], last[filled]
        self.text = np.searchsorted(self.offsets, self.begin, side="right") - 1
        over = Prefix(self.words)
        self.line = over.between(self.first, self.last).view(np.int64)
        lead = np.minimum(self.first + DEPTH, self.last)
        self.leaf = mix(over.between(self.first, lead) + mix((self.last - self.first).astype(np.uint64))).view(np.int64)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, line, doc, first): the different lines of a document; ``first`` is 1 for the first of them in its leaf."""
    for batch in batches:
        for part in batch_slices(batch, "text"):
            lines = Lines(part.column("text"))
            order = np.lexsort((lines.line, lines.leaf, lines.text))
            text, leaf, line = lines.text[order], lines.leaf[order], lines.line[order]
            next_leaf = np.concatenate([[True], (text[1:] != text[:-1]) | (leaf[1:] != leaf[:-1])])[: len(text)]
            keep = next_leaf | np.concatenate([[True], line[1:] != line[:-1]])[: len(text)]
            doc = part.column("doc").to_numpy()[text[keep]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf[keep]), pa.array(line[keep]), pa.array(doc), pa.array(next_leaf[keep].astype(np.int64))], ["leaf", "line", "doc", "first"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, line, words): the different lines of a slice with the hashes of their words."""
    for batch in batches:
        for part in batch_slices(batch, "text"):
            lines = Lines(part.column("text"))
            at = np.unique(lines.line, return_index=True)[1]
            counts = lines.last[at] - lines.first[at]
            spread = np.repeat(lines.first[at] - np.concatenate([[0], np.cumsum(counts)[:-1]])[: len(at)], counts) + np.arange(counts.sum())
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(lines.words.view(np.int64)[spread]))
            yield pa.RecordBatch.from_arrays([pa.array(lines.leaf[at]), pa.array(lines.line[at]), words], ["leaf", "line", "words"])


def _templates(docs: DataFrame, lines: DataFrame, min_documents: int, similarity: float) -> DataFrame:
    """(leaf, line, template) of the lines that have their leaf's template."""
    counted = durable(lines.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.sum("first").alias("docs")))
    open_leaves = durable(
        counted.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("lines"))
        .where((F.col("docs") >= min_documents) & (F.col("lines") > 1)).select("leaf"))
    few = F.broadcast(open_leaves) if open_leaves.count() <= BROADCAST_LEAVES else open_leaves  # at most 8 MB
    worded = durable(
        docs.select("text").mapInArrow(_words, "leaf bigint, line bigint, words array<bigint>").join(few, "leaf", "left_semi")
        .groupBy("leaf", "line").agg(F.first("words").alias("words")).join(counted.select("leaf", "line", "n"), ["leaf", "line"]))
    places = worded.select("leaf", "n", F.posexplode("words").alias("at", "word")).groupBy("leaf", "at", "word").agg(F.sum("n").alias("n"))
    constants = (
        places.groupBy("leaf", "at").agg(F.max(F.struct("n", "word")).alias("top"), F.sum("n").alias("all"))
        .select("leaf", "at", F.when(F.col("top.n") * 2 >= F.col("all"), F.col("top.word")).otherwise(VARIABLE).alias("word"))
        .groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("constants"))
    )
    agrees = F.size(F.filter(F.zip_with("words", "constants", lambda a, b: (a == b) & (b != VARIABLE)), lambda x: x))
    return worded.join(constants, "leaf").where(agrees >= F.lit(float(similarity)) * F.size("words")).select("leaf", "line", F.col("leaf").alias("template"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch_slices(batch, "text"):
            lines = Lines(part.column("text"))
            dropped = part.column("dropped")
            own = np.concatenate([[0], np.cumsum(dropped.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            values = dropped.flatten().to_numpy()
            begin = np.searchsorted(lines.text, np.arange(part.num_rows + 1))
            left, gone = [], []
            raw = lines.data.tobytes()
            for i in range(part.num_rows):
                here = slice(begin[i], begin[i + 1])
                drop = np.isin(lines.line[here], values[own[i] : own[i + 1]])
                gone.append(int(drop.sum()))
                # A dropped line goes with the line feed behind it, or at the end with the one before.
                at, kept = lines.offsets[i], []
                for a, b in zip(lines.begin[here][drop], lines.end[here][drop]):
                    kept.append(raw[at:a])
                    at = min(b + 1, lines.offsets[i + 1])
                kept.append(raw[at : lines.offsets[i + 1]])
                left.append(b"".join(kept).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(begin)), pa.array(gone, pa.int64()), pa.array(left)], ["doc_id", "n_lines", "n_dropped", "kept_text"])


def recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, line): the different lines of each (doc, text) row that have a recurring template."""
    once = docs.select("doc", "text")
    lines = durable(once.mapInArrow(_leaves, "leaf bigint, line bigint, doc bigint, first bigint").dropDuplicates(["leaf", "line", "doc"]))
    templates = _templates(once, lines, min_documents, similarity)
    named = durable(lines.join(templates, ["leaf", "line"], "left").select("doc", "line", F.coalesce("template", "line").alias("template")))
    recurring = named.select("template", "doc").distinct().groupBy("template").count().where(F.col("count") >= min_documents).select("template")
    return named.join(recurring, "template", "left_semi").select("doc", "line")


def without_recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = ordered_rows(docs.select("doc_id", "text"))
    # A list holds lines of one document.
    lists = durable(recurring_lines(docs, min_documents, similarity).groupBy("doc").agg(F.collect_list("line").alias("dropped")))
    hit, names = lists.select("doc"), ["doc_id", "text", "dropped"]
    # Only texts that lose lines move. The lists grow with the corpus, so they are never broadcast.
    touched = only(docs, hit, "left_semi").join(lists.hint("merge"), "doc").select(*names)
    whole = only(docs, hit, "left_anti").withColumn("dropped", F.lit(None).cast("array<bigint>")).select(*names)
    return touched.unionByName(whole).mapInArrow(
        _without, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_text string")


def op10_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return without_recurring_lines(documents(spark, folder)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
