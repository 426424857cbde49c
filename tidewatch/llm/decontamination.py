"""Benchmark decontamination with suffix arrays of the training words.

Every slice of training texts (a shard) gets a suffix array of its words, sparse in that suffixes which cannot hold a
whole window of benchmark words are left out. Every suffix of every test item is binary-searched in it. The stretch of
the array that starts with a window gives all its places; windows that follow each other on one diagonal are joined
to the longest verbatim matches. Documents are whole in a shard, so nothing is shuffled, however often a passage recurs.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lower-cased, told apart by a 64-bit hash.
The benchmark is sent to the tasks in blocks of bounded size; with several blocks the documents pass through one step
per block.

Defined cases: a null or empty text has no words and is clean; a null or empty item has no window; rows of the benchmark
that share an item_id are one item; an empty benchmark contaminates nothing; repeated documents are judged alike;
other columns are passed through by ``clean_documents`` and ignored by ``contamination``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents
from .texts import ALNUM, LOWER, Prefix, batch_slices, per_text, runs, text_bytes, words_of

WINDOW = 10
BLOCK_BYTES = 16_000_000


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    lowered = LOWER[data]
    starts, ends, first = words_of(lowered, offsets, ALNUM)
    return Prefix(lowered).between(starts, ends), first


class Items:
    """One block of the benchmark: its vocabulary, and its windows as sorted rows of word numbers."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        hashes, first = _word_hashes(pa.array(texts, pa.large_string()))
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        numbers = (numbers + 1).astype(np.int32)
        self.ids, self.window = ids, window
        rows, widths, items, places = [], [], [], []
        for i in range(len(ids)):
            words = numbers[first[i] : first[i + 1]]
            width = min(window, len(words))
            for at in range(len(words) - width + 1 if width else 0):
                rows.append(np.pad(words[at : at + width], (0, window - width)))
                widths.append(width)
                items.append(i)
                places.append(at)
        self.windows = np.array(rows, np.int32).reshape(-1, window)
        self.widths, self.items, self.places = (np.array(x, np.int64) for x in (widths, items, places))
        self.shortest = int(self.widths.min()) if len(self.widths) else 0

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1; 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` words from there on, by doubling; 0 ends a suffix."""
    rank = words.astype(np.int64)
    width = 1
    while width < depth:
        later = np.zeros_like(rank)
        later[:-width] = rank[width:]
        pair = rank * (int(rank.max(initial=0)) + 1) + later
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
        rank[words == 0] = 0
        width *= 2
    return np.argsort(rank, kind="stable")


def _keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class Shard:
    """Suffix array over the stretches of a slice of texts in which benchmark words follow each other."""

    def __init__(self, numbers: np.ndarray, first: np.ndarray, items: Items):
        inside = numbers > 0
        begins, ends = runs(inside, first)
        long_enough = (ends - begins >= items.shortest) & (ends > begins)
        begins, ends = begins[long_enough], ends[long_enough]
        lengths = ends - begins
        n = int(lengths.sum()) + len(begins)
        # The kept stretches one after the other, a 0 behind each.
        self.words, self.place = np.zeros(n, np.int32), np.full(n, -1, np.int64)
        if len(begins):
            start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            to = np.repeat(start - begins, lengths) + (at := _ranges(begins, lengths))
            self.words[to], self.place[to] = numbers[at], at
        width = items.window
        order = suffix_array(self.words, width)
        self.order = order[self.words[order] > 0]
        padded = np.concatenate([self.words, np.zeros(width, np.int32)])
        rows = padded[self.order[:, None] + np.arange(width)]
        rows[np.cumsum(rows == 0, axis=1) > 0] = 0
        self.keys = _keys(rows)

    def occurrences(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """(window number, word number) of every place where a window of an item stands."""
        if not len(self.order) or not len(items.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = items.windows.astype(np.int64)
        top[np.arange(items.window) >= items.widths[:, None]] = (1 << 32) - 1
        low = np.searchsorted(self.keys, _keys(items.windows), side="left")
        high = np.searchsorted(self.keys, _keys(top), side="right")
        count = high - low
        window = np.repeat(np.arange(len(low)), count)
        return window, self.place[self.order[_ranges(low, count)]]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = int(lengths.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths) + np.arange(total)


def _hits(column: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each text, and the occurrences: window, word number, text number."""
    hashes, first = _word_hashes(column)
    window, at = Shard(items.numbers(hashes), first, items).occurrences(items)
    return first, window, at, per_text(first, at)


def _longest(window: np.ndarray, at: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """Longest matches (item, item word, document word, words) from the occurrences in one text."""
    item, place, width = items.items[window], items.places[window], items.widths[window]
    order = np.lexsort((at, at - place, item))
    item, place, width, at = item[order], place[order], width[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | ((at - place)[1:] != (at - place)[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return [(int(item[b]), int(place[b]), int(at[b]), int(at[e] - at[b] + width[e])) for b, e in zip(begin, end)]


_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("words", pa.int64())]))
MATCHES = "array<struct<item_id:string,item_word:bigint,word:bigint,words:bigint>>"


def _report(items: Items, keep_text: bool, names: list[str]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        for batch in batches:
            for part in batch_slices(batch, "text"):
                first, window, at, text = _hits(part.column("text"), block)
                order = np.argsort(text, kind="stable")
                cut = np.searchsorted(text[order], np.arange(part.num_rows + 1))
                before = part.column("matches").to_pylist() if "matches" in names else [[]] * part.num_rows
                found = []
                for i in range(part.num_rows):
                    mine = order[cut[i] : cut[i + 1]]
                    found.append(before[i] + [
                        {"item_id": block.ids[item], "item_word": place, "word": word - int(first[i]), "words": n}
                        for item, place, word, n in (_longest(window[mine], at[mine], block) if len(mine) else [])
                    ])
                columns = [part.column(n) for n in names if n not in ("text", "n_words", "matches")]
                columns += [part.column("text")] if keep_text else []
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(first), pa.int64()), pa.array(found, _MATCH)],
                    [*[n for n in names if n not in ("text", "n_words", "matches")], *(["text"] if keep_text else []), "n_words", "matches"],
                )

    return step


def _blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """The benchmark as broadcast blocks of about ``block_bytes`` of text each, one in the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for i in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        block.sort(key=lambda r: (r["item_id"] or "", r["text"] or ""))
        yield benchmark.sparkSession.sparkContext.broadcast(Items([r["item_id"] or "" for r in block], [r["text"] for r in block], window)), i == n - 1


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, matches): the longest verbatim matches of at least one window, with their places."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found, names = docs.select("doc_id", "text"), ["doc_id", "text"]
    for items, last in _blocks(benchmark, window, block_bytes):
        schema = f"doc_id {kind}, " + ("" if last else "text string, ") + f"n_words bigint, matches {MATCHES}"
        found = found.mapInArrow(_report(items, not last, names), schema)
        names = found.columns
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words inside a match, items with a match, and whether there is one."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, names = [], []
            for found in batch.column("matches").to_pylist():
                covered, end = 0, 0
                for m in sorted(found, key=lambda m: m["word"]):
                    begin = max(end, m["word"])
                    end = max(end, m["word"] + m["words"])
                    covered += max(0, end - begin)
                hit.append(covered)
                names.append(sorted({m["item_id"] for m in found}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array([h > 0 for h in hit])],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return matches(docs, benchmark, window).mapInArrow(
        digest, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no window of the benchmark."""
    place = docs.columns.index("text")

    def step(items):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in batch_slices(batch, place):
                    hit = np.zeros(part.num_rows, bool)
                    hit[_hits(part.column(place), items.value)[3]] = True
                    yield part.filter(pa.array(~hit))

        return clean

    for items, _ in _blocks(benchmark, window, block_bytes):
        docs = docs.mapInArrow(step(items), T.StructType(docs.schema.fields))
    return docs


def op1_benchmark_suffix_search(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(documents(spark, folder), documents(spark, folder, "benchmark"))
