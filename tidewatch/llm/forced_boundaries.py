"""Byte-level BPE ids by forced-boundary splitting.

A pair of bytes that stands in no token of the vocabulary can never be merged over, so a text may be cut there. These
cuts, together with those of the tokenizer's own split into letters, numbers, signs and white space, leave short
fragments; each distinct fragment is merged once by the tokenizer's merge rules, and the ids of the fragments are joined.
Merges never reach over a cut, so the ids are those of the whole text.

A long text is worked off in blocks that end before white space that follows something else, which is a cut wherever
it stands; so no array is longer than a block plus the longest stretch without such a place.

Defined cases: a null text is an empty one and has no ids; strings of added tokens become their ids, as in the library's
``encode``; rows that repeat are encoded again; other columns are not read; an empty table gives no rows. Tokenizer
files of other kinds (normalizers, added tokens that strip spaces, models with dropout or unknown tokens) are refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .texts import Prefix, batch_slices, text_bytes
from .tokens import default_path

BLOCK_BYTES = 500_000
KNOWN_FRAGMENTS = 1_000_000  # a worker remembers so many fragments and then starts anew
UNSEEN, SPACE, LETTER, NUMBER, SIGN = 0, 1, 2, 3, 4
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values of the tokenizer's pattern


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


class ForcedBoundaryCoder:
    """Encodes blocks of text and decodes ids; holds the vocabulary's byte pairs and the fragments met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        odd = [t for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
        if (
            spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
            or model.get("type") != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("ignore_merges") or odd
        ):
            raise ValueError("forced-boundary splitting needs a plain byte-level BPE file")
        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._split = self._tokenizer.model, self._tokenizer.pre_tokenizer
        self._character = _byte_characters()
        self._as_text = bytes(range(256)).decode("latin-1").maketrans({chr(b): c for b, c in enumerate(self._character)})
        byte_of = {c: b for b, c in enumerate(self._character)}
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        tokens = {i: bytes(byte_of[c] for c in token) for token, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        if not {bytes([b]) for b in range(256)} <= set(tokens.values()):
            raise ValueError("the vocabulary lacks single bytes")
        # Bytes of all tokens, one after the other, for decoding.
        size = max(tokens) + 1
        self._width = np.zeros(size, np.int64)
        for i, t in tokens.items():
            self._width[i] = len(t)
        self._from = np.concatenate([[0], np.cumsum(self._width)])
        self._bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        #: True for pairs of bytes, 256 * first + second, that stand inside some token.
        self.joined = np.zeros(1 << 16, bool)
        added = set(self.added.values())
        for i, t in tokens.items():
            if i not in added and len(t) > 1:
                b = np.frombuffer(t, np.uint8).astype(np.int64)
                self.joined[b[:-1] * 256 + b[1:]] = True
        self._class = np.zeros(0x110000, np.uint8)
        self._forget()

    def _forget(self) -> None:
        self._known, self._number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._begin, self._ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _classes(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point as the tokenizer's own pattern sees it: a character goes with one of its class before it."""
        new = np.unique(points[self._class[points] == UNSEEN])
        for p in new.tolist():
            kinds = [k for before, k in (("a", LETTER), ("1", NUMBER), ("!", SIGN)) if len(self._split.pre_tokenize_str(before + chr(p))) == 1]
            self._class[p] = kinds[0] if kinds else SPACE
        return self._class[points]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where fragments begin, as byte numbers, in texts that lie one after the other."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        end = np.append(lead[1:], len(data))
        width = end - lead
        points = data[lead].astype(np.int64)
        points[width == 2] &= 0x1F
        points[width == 3] &= 0x0F
        points[width == 4] &= 0x07
        for k in (1, 2, 3):
            more = width > k
            points[more] = points[more] << 6 | (data[lead[more] + k] & 0x3F)
        kind = self._classes(points)
        n = len(lead)
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        first_of_text = np.searchsorted(lead, offsets[:-1][offsets[:-1] < len(data)])
        new[first_of_text] = True
        starts = np.flatnonzero(new)  # runs of one class, in characters
        ends = np.append(starts[1:], n)
        last_of_text = np.append(np.isin(starts[1:], first_of_text), True)
        cut = np.zeros(n + 1, bool)
        cut[starts] = True
        # White space before something else: its last character is apart, and if that is a blank, it goes with what follows.
        spaces = np.flatnonzero((kind[starts] == SPACE) & ~last_of_text)
        cut[ends[spaces] - 1] = True
        blank = points[ends[spaces] - 1] == 0x20
        cut[ends[spaces][blank]] = False
        # 's 't 're 've 'm 'll 'd behind a lone apostrophe at which a piece begins.
        lone = np.flatnonzero((ends - starts == 1) & (points[starts] == 0x27) & cut[starts] & ~last_of_text)
        lone = lone[kind[ends[lone]] == LETTER]
        for run in lone.tolist():
            letters = "".join(map(chr, points[starts[run + 1] : min(ends[run + 1], starts[run + 1] + 2)].tolist()))
            for c in _CONTRACTIONS:
                if letters.startswith(c):
                    cut[starts[run + 1]] = False
                    cut[starts[run + 1] + len(c)] = True
                    break
        begins = np.zeros(len(data), bool)
        begins[lead[cut[:-1]]] = True
        pairs = data[:-1].astype(np.int64) * 256 + data[1:]
        begins[1:] |= ~self.joined[pairs]
        return np.flatnonzero(begins)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other, and where those of each text begin (one more entry for the end)."""
        raw, added = data.tobytes(), []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[text + 1]:
                    added.append((at, token))
                    at = raw.find(token, at + len(token))
                else:
                    at = raw.find(token, at + 1)
        # What lies between added tokens is encoded like a text of its own.
        places = sorted(added)
        borders = np.unique(np.concatenate([offsets, [a for a, _ in places], [a + len(t) for a, t in places]]).astype(np.int64))
        starts = self.cuts(data, borders) if len(data) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        counts = np.zeros(len(starts), np.int64)
        plain = np.ones(len(starts), bool)
        marks = []
        for at, token in places:
            lo, hi = np.searchsorted(starts, [at, at + len(token)])
            plain[lo:hi] = False
            marks.append((lo, self.added[token]))
            counts[lo] = 1
        piece = self._numbers(raw, data, starts[plain], ends[plain])
        lengths = self._begin[piece + 1] - self._begin[piece]
        counts[plain] = lengths
        before = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(int(before[-1]), np.uint32)
        fill = np.ones(len(out), bool)
        for lo, i in marks:
            out[before[lo]], fill[before[lo]] = i, False
        source = np.repeat(self._begin[piece] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        out[fill] = self._ids[source]
        return out, before[np.searchsorted(starts, offsets)]

    def _numbers(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each fragment among those remembered; new ones are merged."""
        if not len(starts):
            return np.zeros(0, np.int64)
        hashes, first, which = np.unique(Prefix(data).between(starts, ends), return_index=True, return_inverse=True)
        if len(self._known) > KNOWN_FRAGMENTS:
            self._forget()
        at = np.searchsorted(self._known, hashes)
        new = np.ones(len(hashes), bool)
        new[at < len(self._known)] = self._known[at[at < len(self._known)]] != hashes[at < len(self._known)]
        if new.any():
            fragments = [raw[a:b].decode("latin-1").translate(self._as_text) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            ids = [[t.id for t in self._model.tokenize(x)] for x in fragments]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            fresh = len(self._begin) - 1 + np.arange(len(ids))
            self._begin = np.concatenate([self._begin, self._begin[-1] + np.cumsum(lengths)])
            self._ids = np.concatenate([self._ids, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))])
            known, number = np.concatenate([self._known, hashes[new]]), np.concatenate([self._number, fresh])
            order = np.argsort(known, kind="stable")
            self._known, self._number = known[order], number[order]
        return self._number[np.searchsorted(self._known, hashes)][which]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens; those of no token are left out, as the library does."""
        ids = ids[ids < len(self._width)]
        width = self._width[ids]
        at = np.repeat(self._from[ids] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        return self._bytes[at].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", "replace")


_coders: dict[str, ForcedBoundaryCoder] = {}


def coder(path: str) -> ForcedBoundaryCoder:
    """One per worker process and file."""
    if path not in _coders:
        _coders[path] = ForcedBoundaryCoder(path)
    return _coders[path]


def blocks(data: np.ndarray, added: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """Stretches of about ``limit`` bytes of one text; each but the last ends after something that is no white space, before a blank.

    A blank inside the string of an added token is no such place.
    """
    start, n = 0, len(data)
    blanks_in_added = any(b" " in t for t in added)
    while n - start > limit and not blanks_in_added:
        size = limit
        while True:
            window = data[start : min(start + size, n)]
            # The byte before is an ASCII sign, number or letter: it is no white space under any rule.
            place = np.flatnonzero((window[1:] == 0x20) & (window[:-1] > 0x20) & (window[:-1] < 0x7F))
            if len(place) or start + size >= n:
                break
            size *= 2
        if not len(place):
            break
        yield data[start : start + place[-1] + 1]
        start += int(place[-1]) + 1
    yield data[start:]


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""
    vocabulary = vocabulary or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            for part in batch_slices(batch, "text", BLOCK_BYTES):
                texts = list(_ids_of_texts(own, part))
                offsets = np.concatenate([[0], np.cumsum([sum(map(len, x)) for x in texts])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint32), *(b for x in texts for b in x)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    vocabulary = vocabulary or default_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            texts = [None if ids is None else own.decode_text(np.array(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")


def _ids_of_texts(own: ForcedBoundaryCoder, part: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """The ids of each text of a slice, in one or several pieces."""
    data, offsets = text_bytes(part.column("text"))
    if part.num_rows == 1 and len(data) > BLOCK_BYTES:
        empty = np.zeros(1, np.int64)
        yield [own.encode(block, np.append(empty, len(block)))[0] for block in blocks(data, list(own.added))]
        return
    ids, first = own.encode(data, offsets)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield [ids[a:b]]


def coding_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; no ids leave the task."""
    vocabulary = vocabulary or default_path()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            for part in batch_slices(batch, "text", BLOCK_BYTES):
                counts, ids_hash, text_hash = [], [], []
                for pieces in _ids_of_texts(own, part):
                    of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0
                    for ids in pieces:
                        of_ids.update(ids.astype("<u4").tobytes())
                        of_text.update(own.decode(ids))  # blocks end between characters, and texts are valid, so bytes are text
                        n += len(ids)
                    counts.append(n)
                    ids_hash.append(of_ids.hexdigest())
                    text_hash.append(of_text.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(digest, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op12_forced_boundary_coding(spark: SparkSession, folder: str) -> DataFrame:
    return coding_digest(documents(spark, folder))
