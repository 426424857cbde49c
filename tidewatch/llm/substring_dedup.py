"""Removal of repeated strings of a given length by refinement of q-gram buckets.

Places of the texts are put into buckets by the q-gram that starts there. A bucket with one place cannot repeat and is
done. The others are refined by what stands at later and earlier offsets until the strings of ``length`` bytes around
each place are told apart, and each refinement is used by all strings that go through the place:

1. Only anchors are placed: q-grams that are the least by hash in some string of ``length`` bytes. Every such string
   holds one, at the same offset in all its copies, so the strings around anchors are all strings (about 1 place in 33).
2. Buckets are named by the hash of the q-gram instead of its rank, and refined at once by the hash of the whole context,
   the bytes in which all strings through the anchor lie. Of equal contexts all but the first are repeats throughout.
3. What is left are the first places of each context in buckets that hold several contexts. They are refined offset by
   offset: the strings that start ``o`` bytes before the anchor are told apart by their hashes, for each o.

Equal contexts of one slice of texts are settled before anything is shuffled, so a passage that a document repeats a
thousand times moves once. Buckets are read as sorted streams. In step 3 a bucket is held in memory up to
``WHOLE_BUCKET`` places; larger ones go through a grouped minimum and a join instead, which Spark can split.

Strings are compared by 64-bit hashes within a bucket. A document is told apart by id and text.

Defined cases: a null text is empty; texts shorter than ``length`` bytes lose nothing; rows equal in id and text are one
document, each with its result; of documents that share an id, and of those without, the order is by hash of the text,
nulls before all others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import anchors
from .common import documents, durable, only, ordered_rows
from .texts import Prefix, batch_slices, mix, text_bytes

LENGTH, GRAM = 100, 28
WHOLE_BUCKET = 20_000
HELD_ROWS = 100_000
_ROWS = ["key", "context", "doc", "at", "start", "end"]
_ROW_TYPES = ", ".join(f"`{c}` bigint" for c in _ROWS)


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], _ROWS)


def _merged(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of stretches, per text."""
    if not len(text):
        return text, start, end
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    # Ends of one text are above all those of the texts before, so that one running maximum serves all.
    lift = text * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], (start + lift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    return text[first], start[first], reach[last] - lift[first]


def _places(length: int, gram: int):
    """Anchors of each text; of those with equal contexts in a slice the first, and of the others the bytes they cover."""
    around = length - gram

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "text"):
                part = part.take(pa.array(np.argsort(part.column("doc").to_numpy(), kind="stable")))
                data, offsets = text_bytes(part.column("text"))
                doc = part.column("doc").to_numpy()
                prefix = Prefix(data)
                at, gram_hash = anchors(prefix, offsets, length, gram)
                text = np.searchsorted(offsets, at, side="right") - 1
                start = np.maximum(at - around, offsets[text])
                end = np.minimum(at + length, offsets[text + 1])
                context = mix(prefix.between(start, end) + mix((at - start).astype(np.uint64)))
                first = np.zeros(len(at), bool)
                first[np.unique(context, return_index=True)[1]] = True
                # A repeated row is the same document: its places are not later ones.
                same = np.concatenate([[False], doc[1:] == doc[:-1]])[text]
                again = ~first & ~same
                base = offsets[text]
                yield _batch(gram_hash[first], context[first], doc[text[first]], (at - base)[first], (start - base)[first], (end - base)[first])
                covered, begin, finish = _merged(text[again], (start - base)[again], (end - base)[again])
                none = np.full(len(covered), -1)
                yield _batch(mix(doc[covered].astype(np.uint64)), none, doc[covered], none, begin, finish)

    return places


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, context, doc, at): repeats of a context, as covered bytes (at = -1), and the first places
    of contexts in buckets with several contexts. Of a bucket that goes on, only its last row and its first place are held."""
    held = np.zeros((0, 6), np.int64)
    key = None  # of the bucket that goes on
    last = pending = None  # its last row; its first place as long as it has one context

    def done(rows):
        nonlocal key, last, pending
        goes_on = key is not None and rows[0, 0] == key
        before = np.vstack([last if goes_on else rows[0] - 1, rows[:-1]])
        real = rows[:, 3] >= 0
        new = (rows[:, :2] != before[:, :2]).any(axis=1)
        same_place = ~new & (rows[:, 2] == before[:, 2]) & (rows[:, 3] == before[:, 3])
        repeats = real & ~new & ~same_place
        first_of_key = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
        number = np.cumsum(first_of_key) - 1
        contexts = np.bincount(number, new & real)
        several = contexts > 1
        firsts = rows[new & real]
        if goes_on and contexts[0]:
            several[0] = True  # it had one at least
            if pending is not None:
                yield _batch(*pending[None].T)
        elif goes_on and pending is None:
            several[0] = True
        yield _batch(*firsts[several[number[new & real]]].T)
        found = rows[repeats].copy()
        found[:, 3] = -1
        yield _batch(*found.T)
        yield _batch(*rows[~real].T)
        single = firsts[number[new & real] == number[-1]]
        if not (goes_on and number[-1] == 0):
            pending = single[0] if len(single) == 1 else None
        elif contexts[0]:
            pending = None
        key, last = rows[-1, 0], rows[-1]

    for batch in batches:
        rows = np.vstack([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
        if not len(rows):
            continue
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0], side="left"))
        if len(rows) - cut > HELD_ROWS:
            cut = len(rows)
        if cut:
            yield from done(rows[:cut])
        held = rows[cut:]
    if len(held):
        yield from done(held)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each place of a text."""
    names = ["key", "doc", "at", "start", "end", "bytes"]
    for batch in batches:
        for part in batch_slices(batch, "text", 500_000):
            rows = [[], [], [], [], [], []]
            for doc, text, places in zip(part.column("doc"), part.column("text"), part.column("places")):
                raw = memoryview(text.as_buffer() or b"")
                for p in places.as_py():
                    for column, value in zip(rows, (p["key"], doc.as_py(), p["at"], p["start"], p["end"], bytes(raw[p["start"] : p["end"]]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:5]), pa.array(rows[5], pa.binary())], names)


def _offset_by_offset(length: int, gram: int):
    """From whole buckets, sorted by (key, doc, at): the bytes of strings that an earlier place of the bucket has as well."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        key, doc, at, start, end = (table.column(c).to_numpy() for c in ("key", "doc", "at", "start", "end"))
        column = pa.concat_arrays(table.column("bytes").chunks).cast(pa.large_binary())
        data, offsets = text_bytes(column)
        prefix, base = Prefix(data), offsets[:-1] - start
        mixed = mix(key.astype(np.uint64))
        found = np.zeros((len(key), length - gram + 1), bool)
        for o in range(length - gram + 1):
            here = np.flatnonzero((at - o >= start) & (at - o + length <= end))
            begin = base[here] + at[here] - o
            strings = mix(prefix.between(begin, begin + length) ^ mixed[here])
            later = np.ones(len(here), bool)
            later[np.unique(strings, return_index=True)[1]] = False
            found[here[later], o] = True
        # Runs of offsets are stretches of bytes.
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        none = np.full(len(row), -1)
        return _batch(key[row], none, doc[row], none, at[row] - high, at[row] - low + length)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            if not held.num_rows:
                continue
            keys = held.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield settle(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield settle(held)

    return refine


def _large_buckets(places: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for buckets of any size: the earliest place of every string by a grouped minimum, joined back."""
    o = F.col("o")
    strings = places.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(length - gram)))).where(
        (F.col("at") - o >= F.col("start")) & (F.col("at") - o + length <= F.col("end"))
    ).select("key", "doc", "at", "o", F.xxhash64(F.substring("bytes", (F.col("at") - o - F.col("start") + 1).cast("int"), F.lit(length))).alias("string"))
    first = strings.groupBy("key", "o", "string").agg(F.min(F.struct("doc", "at")).alias("first"))
    return strings.join(first, ["key", "o", "string"]).where(F.struct("doc", "at") > F.col("first")).select(
        "doc", (F.col("at") - o).alias("start"), (F.col("at") - o + length).alias("end"))


def repeated_stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, whole_bucket: int = WHOLE_BUCKET) -> DataFrame:
    """(doc, start, end): bytes of (doc, text) rows in a string of ``length`` bytes that also starts earlier; they overlap."""
    placed = docs.select("doc", "text").mapInArrow(_places(length, gram), _ROW_TYPES)
    buckets = durable(
        placed.repartition("key").sortWithinPartitions("key", "context", "doc", "at").mapInArrow(_first_of_each, _ROW_TYPES))
    open_places = buckets.where(F.col("at") >= 0)
    by_doc = durable(open_places.groupBy("doc").agg(F.collect_list(F.struct("key", "at", "start", "end")).alias("places")))
    texts = only(docs.select("doc", "text"), by_doc.select("doc"), "left_semi").join(by_doc, "doc").dropDuplicates(["doc"])
    around = texts.mapInArrow(_contexts, "key bigint, doc bigint, at bigint, start bigint, `end` bigint, bytes binary")
    large = durable(open_places.groupBy("key").count().where(F.col("count") > whole_bucket).select("key"))
    settled = buckets.where(F.col("at") < 0).select("doc", "start", "end")
    if large.isEmpty():
        small, rest = around, None
    else:
        around = durable(around)
        few = F.broadcast(large)  # each has more than whole_bucket places, so there are few
        small, rest = around.join(few, "key", "left_anti"), around.join(few, "key", "left_semi")
    names = ["key", "doc", "at", "start", "end", "bytes"]
    refined = small.select(*names).repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(_offset_by_offset(length, gram), _ROW_TYPES)
    found = settled.unionByName(refined.select("doc", "start", "end"))
    return found.unionByName(_large_buckets(rest, length, gram)) if rest is not None else found


def _cut(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                lists = part.column("stretches")
                counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten()
                text, start, end = _merged(np.repeat(np.arange(part.num_rows), counts), *(flat.field(i).to_numpy() for i in (0, 1)))
                # Stretches that touch are one.
                edge = np.zeros(len(data) + 1, np.int8)
                np.add.at(edge, offsets[text] + start, 1)
                np.add.at(edge, offsets[text] + end, -1)
                keep = np.cumsum(edge[:-1]) == 0
                sizes = np.diff(offsets)
                removed = sizes - np.diff(np.concatenate([[0], np.cumsum(keep)])[offsets])
                left = [data[a:b][keep[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                columns = [part.column("doc_id"), pa.array(sizes), pa.array(removed), pa.array(np.bincount(text, minlength=part.num_rows)),
                           pa.array([hashlib.sha256(x).hexdigest() for x in left])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    # A cut may fall inside a character; what is left of it is replaced.
                    columns.append(pa.array([x.decode("utf-8", "replace") for x in left]))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True, whole_bucket: int = WHOLE_BUCKET
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = ordered_rows(docs.select("doc_id", "text"))
    found = repeated_stretches(docs, length, gram, whole_bucket)
    # A document has at most some stretches per anchor, so a list is bounded by its text.
    lists = durable(found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("stretches")))
    hit = lists.select("doc")
    names = ["doc_id", "text", "stretches"]
    touched = only(docs, hit, "left_semi").join(lists, "doc").select(*names)
    whole = only(docs, hit, "left_anti").select("doc_id", "text", F.lit(None).cast(lists.schema["stretches"].dataType).alias("stretches"))
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept_text string" if with_text else "")
    return touched.unionByName(whole).mapInArrow(_cut(with_text), schema)


def op3_repeated_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(documents(spark, folder), with_text=False)
