"""Byte-level BPE ids of whole texts, with the tokenizers library, each distinct piece encoded once.

The tokenizer cuts a text into pieces (words with a leading space, numbers, signs, white space) and encodes each by
itself. The pieces are found here by array operations, and the library encodes those that the worker has not met yet.
Texts with characters beyond Latin letters, or with the string of an added token, are given to the library as a whole,
as are all texts if the tokenizer file is of another kind. Both ways give the ids of ``encode`` on the whole text.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from .texts import Prefix, text_bytes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
LATIN_END = 0x250  # below, no character has changed its class for many versions of Unicode
KNOWN_PIECES = 1_500_000  # pieces that a worker remembers; beyond, it starts anew
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    found = np.zeros(LATIN_END, np.uint8)
    for c in range(LATIN_END):
        kind = unicodedata.category(chr(c))[0]
        found[c] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    found[[9, 10, 11, 12, 13, 32]] = SPACE
    return found


_CLASS = _classes()


def _leads() -> np.ndarray:
    """Class of the character that a lead byte and its follower make, by 256 * lead + follower."""
    table = np.zeros(1 << 16, np.uint8)
    for c in range(0x80, LATIN_END):
        a, b = chr(c).encode()
        table[a * 256 + b] = _CLASS[c]
    return table


_PAIR_CLASS = _leads()


class Encoder:
    """Encodes the texts of a batch; keeps the ids of pieces it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        before = spec.get("pre_tokenizer") or {}
        self.piecewise = (
            spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
            and before.get("use_regex", True) and not spec["model"].get("dropout")
        )
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.vocabulary = self.tokenizer.get_vocab_size()
        # Bytes of each id: a character of a byte-level token stands for one byte, an added token for its own text.
        self.id_bytes = np.zeros(self.vocabulary, np.int64)
        special = {t["id"]: len(t["content"].encode()) for t in spec.get("added_tokens", [])}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.id_bytes[i] = special.get(i, len(token))
        self._forget()

    def _forget(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin (one more entry for the end)."""
        data, offsets = text_bytes(column)
        n = len(column)
        whole = self._not_piecewise(data, offsets)
        starts, ends = _pieces(data, offsets)
        text = np.searchsorted(offsets, starts, side="right") - 1
        usual = ~whole[text]
        starts, ends, text = starts[usual], ends[usual], text[usual]
        piece = self._numbers(data, starts, ends)
        lengths = (self.begin[1:] - self.begin[:-1])[piece] if len(piece) else np.zeros(0, np.int64)
        counts = np.bincount(text, lengths, n).astype(np.int64)
        apart = {}
        if whole.any():
            at = np.flatnonzero(whole)
            texts = [bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace") for i in at]
            for i, e in zip(at, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                apart[int(i)] = np.array(e.ids, np.uint32)
                counts[i] = len(apart[int(i)])
        begins = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(int(begins[-1]), np.uint32)
        fill = np.ones(len(out), bool)
        for i, ids in apart.items():
            out[begins[i] : begins[i + 1]] = ids
            fill[begins[i] : begins[i + 1]] = False
        if len(piece):
            total = int(lengths.sum())
            from_ = np.repeat(self.begin[piece] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(total)
            out[fill] = self.ids[from_]
        return out, begins

    def _not_piecewise(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.piecewise:
            return np.ones(n, bool)
        # Two-byte characters from U+00A1 on have leads C2 (with a follower from A1 on) to C9 (up to U+024F).
        odd = data > 0xC9
        high = np.flatnonzero(data == 0xC2)
        odd[high[data[np.minimum(high + 1, len(data) - 1)] < 0xA1]] = True
        high = np.flatnonzero(data == 0xC9)
        odd[high[data[np.minimum(high + 1, len(data) - 1)] > 0x8F]] = True
        whole = np.diff(np.concatenate([[0], np.cumsum(odd)])[offsets]) > 0
        raw = data.tobytes()
        for word in self.added:
            at = raw.find(word)
            while at >= 0:
                whole[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(word, at + 1)
        return whole

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        hashes, first, which = np.unique(Prefix(data).between(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        new = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), bool)
        if new.any():
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
            fresh = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(ids))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, flat])
            known, number = np.concatenate([self.known, hashes[new]]), np.concatenate([self.number, fresh])
            order = np.argsort(known, kind="stable")
            self.known, self.number = known[order], number[order]
        return self.number[np.searchsorted(self.known, hashes)][which]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the tokenizer's pieces: runs of letters, numbers or other signs, each with one space before it
    if there is one, the English contractions, and white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.where(data < 0x80, _CLASS[np.minimum(data, 0x7F)], 0).astype(np.uint8)
    high = np.flatnonzero(data >= 0xC0)
    high = high[high + 1 < n]
    kind[high] = kind[high + 1] = _PAIR_CLASS[data[high].astype(np.int64) * 256 + data[high + 1]]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    space = kind[starts] == SPACE
    last_of_text = np.zeros(len(starts), bool)
    last_of_text[np.searchsorted(starts, offsets[1:][offsets[1:] > 0]) - 1] = True
    follows = space & ~last_of_text  # white space with something behind it in the same text
    gives = follows & (data[ends - 1] == 0x20)  # its last space goes to what follows
    alone = follows & ~gives & (ends - starts > 1)  # its last character is a piece of its own
    takes = np.zeros(len(starts), bool)
    takes[1:] = gives[:-1]
    new_starts, new_ends = starts - takes, ends - gives
    # 's 't 're 've 'm 'll 'd: a sign run that is one apostrophe with no space before it, and letters behind it.
    mark = np.flatnonzero((ends - starts == 1) & (data[starts] == 0x27) & ~takes & ~last_of_text)
    mark = mark[(kind[starts[np.minimum(mark + 1, len(starts) - 1)]] == LETTER)] if len(mark) else mark
    for m in mark.tolist():
        letters = bytes(data[starts[m + 1] : min(ends[m + 1], starts[m + 1] + 2)]).decode("utf-8", "ignore")
        for c in _CONTRACTIONS:
            if letters.startswith(c):
                new_ends[m] += len(c)
                new_starts[m + 1] += len(c)
                break
    extra = ends[alone] - 1
    new_ends[alone] -= 1
    starts, ends = np.concatenate([new_starts, extra]), np.concatenate([new_ends, extra + 1])
    filled = ends > starts
    starts, ends = starts[filled], ends[filled]
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    """The public byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
