"""Spelling variants: words that differ by one letter, found by PartEnum signatures of letter multisets.

A word's letters are a binary vector with one dimension per letter and occurrence ("aab": a1, a2, b1). One inserted,
deleted or replaced letter moves the vector by a Hamming distance of at most two, so of three parts of the dimensions
at least one is equal in both words. PartEnum enumerates the parts; each part's exact content is a signature, and
signatures are equi-joined.

A multiset forgets the order, and words made of the same syllables share their letters. So the vector is taken of the one
third of a word that holds the edit, and the signature also holds the other two thirds as they stand: every edit lies in
some third of the shorter word. A word therefore has signatures as the shorter (or equally long) and as the longer word
of a pair: 2 roles x 3 places of the edit x 3 parts. Candidates are verified by edit distance, so no hash decides.

Defined cases: a null text or one without letters has no words; a null doc_id stands as an empty string before the colon;
rows that repeat count again; ties between near words go to the smallest in code-point order; an empty table
gives no rows; other columns are not read. A word's near words are at most its length times the alphabet, so no group is
unbounded; signatures of very common stretches are split by Spark's skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable
from .texts import Prefix, batch_slices, mix, text_bytes

#: Fixed values of the damage that stands in for misspellings, and of the words that count.
DAMAGED_ONE_IN, LEAST_LETTERS, LEAST_COUNT = 97, 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECES, PARTS = 3, 3
SLICE_BYTES = 200_000


def damaged_words(docs: DataFrame, one_in: int = DAMAGED_ONE_IN) -> DataFrame:
    """(word) for every run of letters, one in about ``one_in`` of them without one of its letters."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("run"))
    crc = F.crc32(F.concat("_doc", F.lit(":"), "run").cast("binary"))
    at = F.pmod("_crc", F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.withColumn("_crc", crc).select(F.when(F.pmod("_crc", F.lit(one_in)) == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, one_in: int = DAMAGED_ONE_IN) -> DataFrame:
    """(word, n): distinct damaged words that are long and common enough."""
    long_enough = damaged_words(docs, one_in).where(F.char_length("word") >= least_letters)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _segment_sums(values: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, segment, values)
    return out


def word_signatures(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(role, row numbers, signatures): role 0 for the shorter or equally long word of a pair, 1 for the longer."""
    data, offsets = text_bytes(column)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each letter
    begin = np.searchsorted(lead, offsets)
    ends = np.append(lead[1:], len(data))
    letters = Prefix(data).between(lead, ends) if len(lead) else np.zeros(0, np.uint64)
    stretch, first, length, n = Prefix(letters), begin[:-1], np.diff(begin), len(column)
    for role in (0, 1):
        shorter = length - role
        for piece in range(PIECES):
            a, b = shorter * piece // PIECES, shorter * (piece + 1) // PIECES
            tail = length - (shorter - b)  # where the letters behind the edited piece begin
            same = mix(stretch.between(first, first + a) + mix(stretch.between(first + tail, first + length) + mix(shorter * PIECES + piece)))
            # The letters of the edited piece, numbered by their occurrence in it.
            width = tail - a
            row = np.repeat(np.arange(n), width)
            at = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first + a, width)
            order = np.lexsort((letters[at], row))
            sorted_row, sorted_letter = row[order], letters[at][order]
            new = np.ones(len(order), bool)
            new[1:] = (sorted_row[1:] != sorted_row[:-1]) | (sorted_letter[1:] != sorted_letter[:-1])
            place = np.arange(len(order))
            occurrence = place - np.maximum.accumulate(np.where(new, place, 0))
            dimension = mix(sorted_letter + mix(occurrence))
            part = dimension % np.uint64(PARTS)
            for p in range(PARTS):
                inside = part == p
                held = _segment_sums(mix(dimension[inside] + np.uint64(1)), sorted_row[inside], n)
                yield role, np.arange(n), mix(same + mix(held + np.uint64(p)))


def signatures(words: DataFrame) -> DataFrame:
    """(word, n, longer, signature) for all signatures of each word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "word", SLICE_BYTES):
                for role, _, found in word_signatures(part.column("word")):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("word"), part.column("n"), pa.array(np.full(len(found), bool(role))), pa.array(found.view(np.int64))],
                        ["word", "n", "longer", "signature"])

    return words.select("word", "n").mapInArrow(sign, "word string, n bigint, longer boolean, signature bigint")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words of (word, n) that differ by exactly one letter, once."""
    signed = durable(signatures(words))
    short = signed.where(~F.col("longer")).select("signature", F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = signed.select("signature", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    found = short.join(other.hint("merge"), "signature").where(
        (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    once = durable(found.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")))
    return once.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        once.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """Add ``root`` to (word, form): the end of the chain of forms. A form is at least twice as common as its word, so
    chains end; each round doubles the steps taken."""
    state = durable(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        step = state.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        moved = durable(state.join(step, F.col("root") == F.col("_at")).select("word", F.col("_to").alias("root"), (F.col("_to") != F.col("root")).alias("_moved")))
        state = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return state


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, one_in: int = DAMAGED_ONE_IN) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with its more common variant and the end of that chain."""
    words = durable(vocabulary(docs, least_letters, least_count, one_in))
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("_best"))
    joined = words.join(best, "word", "left")
    common = -F.col("_best.less") >= 2 * F.col("n")
    forms = durable(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("_best.near")).alias("form"),
        F.when(common, -F.col("_best.less")).alias("form_n")))
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(documents(spark, folder))
