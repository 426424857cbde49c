"""Similarity join of word-shingle sets by parity sketches.

Two sets of a and b shingles with a Jaccard similarity of at least p / q differ in at most ``(q - p) / (q + p) * (a + b)``
shingles. Every shingle is XORed into one chunk of a sketch, so at most as many chunks differ as shingles do: in a band
of sizes with bound k, sketches of k + 1 + s chunks agree in s + 1 chunks at least. Sets are joined on the chunks
they have in common. Chunks with one shingle or none say little; a set may leave out up to s of them and still shares a
chunk with every partner. A set with more of them also offers the prefix of its sorted shingles, which covers
the pairs of two such sets. Bands are so wide that partners lie in one band or in neighbouring ones; a set enters both.

Who shares a chunk is paired with the first of the group only, where the order is one of four by the chunk. Pairs that
are too far apart by size or by the Hamming distance of their parity sketches, a lower bound of the difference, are
dropped: first by sketches of 512 bits, then by sketches of at least four bits per shingle. The rest is verified on the sets.
After linked sets have been united, groups whose members are still apart are compared in blocks: the sketches of two blocks,
folded to a quarter of their bits, meet in one array step, and only pairs that they do not rule out become rows, which then
face the whole sketches. So no link is lost.

Copies are one class from the start, known by hashes of the whole set, and move as one row from each slice of texts.

Defined cases: a text without words, or null, has size 0 and is linked with nothing; a text of fewer words than a
shingle is one shingle of its own length; rows that share an id count as one document; a row without an id is linked
like others, but a component is named by its smallest id that is not null; an empty table gives no rows; other columns
are not read. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable
from .components import components
from .texts import LOWER, NOT_SPACE, SMALL_SLICE_BYTES, Prefix, batch_slices, group_windows, mix, per_text, text_bytes, words_of

SHINGLE = 4
THRESHOLD = (85, 100)


class Sets:
    """The shingle sets of the texts of one slice: sorted 64-bit hashes, one text after the other."""

    def __init__(self, column: pa.Array, width: int = SHINGLE):
        data, offsets = text_bytes(column)
        data = LOWER[data]
        starts, ends, first = words_of(data, offsets, NOT_SPACE)
        words = Prefix(data).between(starts, ends)
        hashes, at = group_windows(words, first, width)
        text = per_text(first, at)
        # A text of fewer words is one shingle, whose hash also tells its length.
        counts = np.diff(first)
        for n in range(1, width):
            short = np.flatnonzero(counts == n)
            if len(short):
                value = np.full(len(short), n, np.uint64)
                for i in range(n):
                    value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[first[:-1][short] + i])
                hashes, text = np.concatenate([hashes, value]), np.concatenate([text, short])
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        self.hashes, self.text = hashes[new], text[new]
        self.begin = np.searchsorted(self.text, np.arange(len(column) + 1))
        self.sizes = np.diff(self.begin)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """XOR of a value per shingle for every text."""
        running = np.bitwise_xor.accumulate(np.concatenate([np.zeros(1, np.uint64), values]))
        return running[self.begin[1:]] ^ running[self.begin[:-1]]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the whole set."""
        n = mix(self.sizes.astype(np.uint64))
        return mix(self.sums(mix(self.hashes + np.uint64(11))) + n), mix(self.sums(mix(self.hashes + np.uint64(12))) + n)

    def sketches(self) -> np.ndarray:
        """Parity of the number of shingles on each of 512 bits, as eight 64-bit numbers per text."""
        bit = mix(self.hashes + np.uint64(13)) & np.uint64(511)
        odd = np.bincount(self.text * 512 + bit.astype(np.int64), minlength=512 * len(self.sizes))
        odd &= 1
        return np.packbits(odd.astype(np.uint8).reshape(-1, 512), axis=1).view(np.int64)

    def wide_sketches(self) -> list[bytes]:
        """Parity sketches of a power of two of bits, at least four per shingle; the longer of two is folded to compare."""
        bits = np.where(self.sizes > 0, 1 << np.ceil(np.log2(np.maximum(4 * self.sizes, 512))).astype(np.int64), 0)
        end = np.cumsum(bits)
        place = mix(self.hashes + np.uint64(15)) & (bits[self.text] - 1).astype(np.uint64)
        odd = np.bincount((end - bits)[self.text] + place.astype(np.int64), minlength=int(end[-1]) if len(end) else 0) & 1
        packed = np.packbits(odd.astype(np.uint8)).tobytes()
        return [packed[(e - n) // 8 : e // 8] for e, n in zip(end.tolist(), bits.tolist())]

    def sets(self) -> list[bytes]:
        return [self.hashes[a:b].tobytes() for a, b in zip(self.begin[:-1], self.begin[1:])]


class Bands:
    """Size bands and, for each, the most shingles in which a pair with its larger set in the band can differ."""

    def __init__(self, threshold: tuple[int, int] = THRESHOLD):
        self.p, self.q = threshold
        self.low = [1]

    def _reach(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * self.q // self.p + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self._reach(int(sizes.max(initial=1)) + 1)
        return np.searchsorted(np.array(self.low), sizes, side="right") - 1

    def chunks(self, band: int) -> tuple[int, int]:
        """Number of chunks and how many of them may be left out; (0, 0) if only equal sets can be partners."""
        while len(self.low) < band + 2:
            self.low.append(self.low[-1] * self.q // self.p + 1)
        most = (self.q - self.p) * 2 * (self.low[band + 1] - 1) // (self.q + self.p)
        slack = 1 + 2 * most // 25
        return (most + 1 + slack, slack) if most else (0, 0)


def _keys(sets: Sets, bands: Bands, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys and the text of each, for the texts that are ``wanted``."""
    band = bands.of(np.maximum(sets.sizes, 1))
    keys, texts, weak = [], [], np.zeros(len(band), bool)
    value = mix(sets.hashes + np.uint64(14))
    for t in np.unique(np.concatenate([band, band + 1])).tolist():
        chunks, slack = bands.chunks(t)
        here = ((band == t) | (band + 1 == t)) & wanted & (sets.sizes > 0)
        if not chunks or not here.any():
            continue
        rows = np.flatnonzero(here[sets.text])
        text = sets.text[rows]
        # Shingles are sorted by hash and chunks are stretches of hashes, so a chunk's shingles stand together.
        chunk = ((sets.hashes[rows] >> np.uint64(32)) * np.uint64(chunks)) >> np.uint64(32)
        place = text * chunks + chunk.astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, len(place)))
        total = np.bitwise_xor.reduceat(value[rows], first)
        heavy = count > 1
        light = chunks - np.bincount(text[first[heavy]], minlength=len(band))
        weak |= here & (light > slack)
        keys.append(mix(total[heavy] ^ mix((place[first[heavy]] % chunks + (t << 32)).astype(np.uint64))))
        texts.append(text[first[heavy]])
    prefix = sets.sizes - -(-sets.sizes * bands.p // bands.q) + 1
    within = np.arange(len(sets.hashes)) - sets.begin[:-1][sets.text]
    rows = np.flatnonzero(weak[sets.text] & (within < prefix[sets.text]))
    keys.append(mix(value[rows] ^ np.uint64(0x5851F42D4C957F2D)))
    texts.append(sets.text[rows])
    return np.concatenate(keys), np.concatenate(texts)


_SKETCH = [f"s{i}" for i in range(8)]


def _describe(width: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "text", SMALL_SLICE_BYTES):
                sets = Sets(part.column("text"), width)
                one, two = (x.view(np.int64) for x in sets.fingerprints())
                sketch = sets.sketches()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("doc_id").cast(pa.int64()).fill_null(0) if not part.column("doc_id").null_count
                     else _filled(part.column("doc_id"), one), *map(pa.array, (sets.sizes, one, two)), *[pa.array(sketch[:, i]) for i in range(8)],
                     pa.array(sets.wide_sketches(), pa.binary())],
                    ["doc_id", "node", "n", "c1", "c2", *_SKETCH, "wide"])

    return describe


def _filled(ids: pa.Array, hashes: np.ndarray) -> pa.Array:
    """The id, or for a null a hash of the set: a node of the graph of links."""
    import pyarrow.compute as pc

    return pc.if_else(pc.is_null(ids), pa.array(hashes), ids.cast(pa.int64()))


def _chunk_keys(width: int, threshold: tuple[int, int]):
    def chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(threshold)
        for batch in batches:
            seen = np.zeros(0, np.int64)
            for part in batch_slices(batch, "text", SMALL_SLICE_BYTES):
                sets = Sets(part.column("text"), width)
                one = sets.fingerprints()[0].view(np.int64)
                wanted = np.zeros(len(one), bool)
                wanted[np.unique(one, return_index=True)[1]] = True  # of equal sets in a batch, one
                wanted &= ~np.isin(one, seen)
                seen = np.concatenate([seen, one[wanted]])
                keys, text = _keys(sets, bands, wanted)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(one[text])], ["key", "c1"])

    return chunk_keys


HELD_ROWS = 100_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, c1): pairs of the first with each other member, and the members of groups of three or more.

    Groups are read as a stream; of a group that goes on, its first member, its size and, up to two, its members are remembered.
    """

    def out(keys, a, b):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(a), pa.array(b)], ["key", "a", "b"])

    def done(keys, c1, key, center, seen, early):
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (c1[1:] != c1[:-1])
        keys, c1 = keys[new], c1[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        head = c1[first].copy()
        goes_on = key is not None and keys[0] == key
        if goes_on:
            if seen <= 2 < size[0] + seen:  # the group is listed from here on, with those that came before
                yield out(np.full(len(early), key), early, early)
            head[0], size[0] = center, size[0] + seen
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        member = c1 != head[group]
        large = size[group] > 2
        yield out(np.zeros(member.sum(), np.int64), head[group][member], c1[member])
        yield out(keys[large], c1[large], c1[large])
        last = c1[first[-1] :]
        known = np.concatenate([early, last]) if goes_on and len(first) == 1 else last
        return int(keys[-1]), int(head[-1]), int(size[-1]), known[:2]

    held_keys, held_c1 = np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, center, seen, early = None, 0, 0, held_c1
    for batch in batches:
        keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
        c1 = np.concatenate([held_c1, batch.column("c1").to_numpy()])
        if not len(keys):
            continue
        # The last group may go on in the next batch; a very long one is handed out in parts.
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if len(keys) - cut > HELD_ROWS:
            cut = len(keys)
        if cut:
            key, center, seen, early = yield from done(keys[:cut], c1[:cut], key, center, seen, early)
        held_keys, held_c1 = keys[cut:], c1[cut:]
    if len(held_keys):
        yield from done(held_keys, held_c1, key, center, seen, early)


def _close_enough(a: str, b: str, threshold: tuple[int, int]):
    """Bounds that every pair of partners keeps: the ratio of sizes, and the parity sketches' distance."""
    p, q = threshold
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    distance = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH), F.lit(0))
    return (n * q >= m * p) & (m * q >= n * p) & (distance * (p + q) <= (n + m) * (q - p))


BROADCAST_IDS = 1_000_000


def _sketched(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes that the wide sketches do not rule out."""
    p, q = threshold

    def distant(x: bytes, y: bytes, n: int, m: int) -> bool:
        x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        return int(np.bitwise_count(x ^ y).sum()) * (p + q) > (n + m) * (q - p)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, m = (batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            yield batch.select(["a", "b"]).filter(pa.array([not distant(*row) for row in zip(x, y, n, m)], pa.bool_()))

    one = classes.select(F.col("rep").alias("a"), F.col("wide").alias("x"), "n")
    two = classes.select(F.col("rep").alias("b"), F.col("wide").alias("y"), F.col("n").alias("m"))
    # The bits of a sketch stand most significant first in a byte, so a half of the bytes is a half of the bits.
    return durable(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(near, "a bigint, b bigint").distinct())


#: Members of a group are compared in blocks of about so many.
BLOCK_ROWS = 1024
#: A member carries so many of its smallest keys, by which a pair that shares several groups is judged in one of them.
LOW_KEYS = 8


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _near_in_block(key, n, component, own, wide, low, threshold) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that no bound rules out, of different components; with two blocks only pairs between them.

    A pair that is known to share a smaller key is left to that key's group.
    """
    p, q = threshold
    words = [np.frombuffer(w, np.uint64) for w in wide]
    width = np.array([len(w) for w in words])
    short = np.stack([_folded(w, 8) for w in words])
    tables = {}  # by width: place of each row among the rows that are as wide, or twice as wide and folded
    for w in np.unique(width).tolist():
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        place = np.full(len(n), -1)
        place[rows] = np.arange(len(rows))
        tables[w] = place, np.stack([_folded(words[r], w) for r in rows.tolist()])
    smaller = [{k for k in np.frombuffer(x, np.int64).tolist() if k < key} for x in low]
    left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
    found = []
    for start in range(0, len(left), 128):
        a = left[start : start + 128]
        x, y = n[a][:, None], n[right][None, :]
        near = (component[a][:, None] != component[right][None, :]) & (x * q >= y * p) & (y * q >= x * p)
        if own.min() == own.max():
            near &= a[:, None] < right[None, :]
        distance = np.zeros(near.shape, np.int64)
        for k in range(8):
            distance += np.bitwise_count(short[a, k][:, None] ^ short[right, k][None, :])
        i, j = np.nonzero(near & (distance * (p + q) <= (x + y) * (q - p)))
        i, j = a[i], right[j]
        for w, (place, table) in tables.items():
            pair = np.flatnonzero(np.minimum(width[i], width[j]) == w)
            some = max(1, 2_000_000 // w)
            for first in range(0, len(pair), some):
                k = pair[first : first + some]
                apart = np.bitwise_count(table[place[i[k]]] ^ table[place[j[k]]]).sum(axis=1, dtype=np.int64)
                good = k[apart * (p + q) <= (n[i[k]] + n[j[k]]) * (q - p)]
                mine = np.array([smaller[u].isdisjoint(smaller[v]) for u, v in zip(i[good].tolist(), j[good].tolist())], bool)
                found.append((i[good][mine], j[good][mine]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _in_blocks(rest: DataFrame, details: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes of different components in a group that the sketches do not rule out.

    A group of m members is cut by hash into m / BLOCK_ROWS blocks, and a member goes once to every pair of blocks that has
    its own. So rows grow with members times blocks, and a task holds two blocks; only pairs that may be partners become rows.
    Members get their ``details`` when their blocks are known, so that sketches move once with each.
    """
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = rest.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("hash", "key"), F.col("blocks")).cast("int"))
    sent = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "hash", "component").join(details, "hash").drop("hash")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(table: pa.Table) -> pa.RecordBatch:
            key, rep, n, component, own = (table.column(c).to_numpy() for c in ("key", "rep", "n", "component", "own"))
            x, y = _near_in_block(key[0], n, component, own, table.column("slim").to_pylist(), table.column("low").to_pylist(), threshold)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y]))], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                if held and tuple(group[first]) != now:
                    yield judged(pa.Table.from_batches(held))
                    held = []
                now = tuple(group[first])
                held.append(batch.slice(first, last - first))
        if held:
            yield judged(pa.Table.from_batches(held))

    return durable(
        sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a bigint, b bigint").distinct())


def _slim(wide: bytes) -> bytes:
    """A sketch folded to a quarter of its bits, at least one per shingle, and no less than 512."""
    words = np.frombuffer(wide, np.uint64)
    return _folded(words, max(8, len(words) // 4)).tobytes()


def _slimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("hash", "low", "rep", "n")), pa.array([_slim(w) for w in batch.column("wide").to_pylist()], pa.binary())],
            ["hash", "low", "rep", "n", "slim"])


def _low_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.array(x, np.int64).tobytes() for x in batch.column("keys").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(keys, pa.binary())], ["hash", "low"])


def _verified(pairs: DataFrame, docs: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, compared shingle by shingle."""
    p, q = threshold
    nodes = durable(pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct())
    needed = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes  # at most 8 MB of ids
    texts = docs.select("doc_id", "text")
    known = texts.where(F.col("doc_id").isNotNull()).join(needed, F.col("doc_id") == F.col("_node"), "left_semi")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "text", SMALL_SLICE_BYTES):
                sets = Sets(part.column("text"), width)
                node = _filled(part.column("doc_id"), sets.fingerprints()[0].view(np.int64))
                yield pa.RecordBatch.from_arrays([node, pa.array(sets.sets(), pa.binary())], ["node", "items"])

    sets = durable(known.unionByName(texts.where(F.col("doc_id").isNull())).mapInArrow(to_sets, "node bigint, items binary"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(q * common >= p * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return durable(both.mapInArrow(compare, "a bigint, b bigint").distinct())


def similar_documents(docs: DataFrame, width: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (doc_id, node, n_shingles, component) per row of ``docs``, and the links (a, b) of nodes found.

    A node stands for all documents of one set and is the smallest id among them; a component is its smallest node.
    The links connect each component, which need not take every pair in it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = durable(docs.mapInArrow(
        _describe(width), "doc_id bigint, node bigint, n bigint, c1 bigint, c2 bigint, " + ", ".join(f"{s} bigint" for s in _SKETCH) + ", wide binary"))
    classes = durable(described.where(F.col("n") > 0).groupBy("c1", "c2", "n").agg(
        F.coalesce(F.min("doc_id"), F.min("node")).alias("rep"), *[F.first(s).alias(s) for s in (*_SKETCH, "wide")]))
    groups = durable(
        docs.mapInArrow(_chunk_keys(width, threshold), "key bigint, c1 bigint").repartition("key")
        .sortWithinPartitions("key", F.xxhash64("c1", F.col("key").bitwiseAND(3)), "c1").mapInArrow(_stars, "key bigint, a bigint, b bigint"))
    close = _close_enough("x", "y", threshold)
    x, y = classes.alias("x"), classes.alias("y")

    def nodes(pairs: DataFrame) -> DataFrame:
        """From pairs of hashes to pairs of nodes that may be partners."""
        return durable(
            pairs.join(x, F.col("a") == F.col("x.c1")).join(y, F.col("b") == F.col("y.c1")).where(close & (F.col("x.rep") != F.col("y.rep")))
            .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())

    stars = nodes(groups.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    links = _verified(_sketched(stars, classes, threshold), docs, width, threshold)
    named = components(links)
    # Groups that still have members in several components.
    # Members move with three numbers each; sketches are added to those that are left.
    placed = classes.join(named, F.col("rep") == F.col("v"), "left").select(F.col("c1").alias("_hash"), F.coalesce("component", "rep").alias("component"))
    member = durable(
        groups.where(F.col("a") == F.col("b")).select("key", F.col("a").alias("hash"))
        .join(placed, F.col("hash") == F.col("_hash")).select("key", "hash", "component"))
    apart = durable(member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(F.col("key").alias("_key")))
    still = durable(member.join(apart, F.col("key") == F.col("_key"), "left_semi"))
    if not still.isEmpty():
        # A member has at most as many keys as its set has shingles.
        low = still.groupBy("hash").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LOW_KEYS).alias("keys")).mapInArrow(_low_keys, "hash bigint, low binary")
        details = durable(low.join(classes, F.col("hash") == F.col("c1")).select("hash", "low", "rep", "n", "wide").mapInArrow(
            _slimmed, "hash bigint, low binary, rep bigint, n bigint, slim binary"))
        more = _verified(_sketched(_in_blocks(still, details, threshold), classes, threshold), docs, width, threshold)
        if not more.isEmpty():
            links = durable(links.unionByName(more))
            named = components(links)
    of_class = classes.join(named, F.col("rep") == F.col("v"), "left").select(
        F.col("c1").alias("_1"), F.col("c2").alias("_2"), F.col("n").alias("_n"), F.coalesce("component", "rep").alias("component"), "rep")
    result = described.join(of_class, (F.col("c1") == F.col("_1")) & (F.col("c2") == F.col("_2")) & (F.col("n") == F.col("_n")), "left").select(
        "doc_id", F.coalesce("rep", "node").alias("node"), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component"))
    return durable(result), links


def near_duplicates(docs: DataFrame, width: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that is reachable by links, itself included."""
    rows, _ = similar_documents(docs, width, threshold)
    unnamed = rows.where(F.col("doc_id").isNull() & (F.col("n_shingles") > 0))
    if unnamed.isEmpty():
        return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    # A component may be named by a node without an id.
    least = rows.where(F.col("n_shingles") > 0).groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("component", "_c")
    return rows.join(least, (F.col("component") == F.col("_c")) & (F.col("n_shingles") > 0), "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest id of their component; a repeated id stays once.

    Rows without an id, and rows without words, have no group and all stay.
    """
    found = near_duplicates(docs, width, threshold)
    gone = found.where((F.col("doc_id") != F.col("component_id")) & (F.col("n_shingles") > 0)).select(F.col("doc_id").alias("_gone")).distinct()
    gone = durable(gone)
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone  # at most 8 MB of ids; then no text moves
    kept = docs.join(few, docs["doc_id"] == F.col("_gone"), "left_anti")
    again = docs.groupBy("doc_id").count().where((F.col("count") > 1) & F.col("doc_id").isNotNull()).select("doc_id")
    again = durable(again)
    if again.isEmpty():
        return kept
    names = docs.columns
    repeated = kept.join(again.withColumnRenamed("doc_id", "_again"), F.col("doc_id") == F.col("_again"), "left")
    once = repeated.where(F.col("_again").isNotNull()).dropDuplicates(["doc_id"])
    return repeated.where(F.col("_again").isNull()).unionByName(once).select(*names)


def op8_parity_sketch_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))
