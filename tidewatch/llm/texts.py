"""Texts of an Arrow batch as one byte array, so that words and windows are found by array operations.

All functions work on the UTF-8 bytes of whole texts. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
#: For work that holds several dozen bytes per byte of text.
SMALL_SLICE_BYTES = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def byte_class(pattern_excludes: str) -> np.ndarray:
    """Flags for the 256 byte values: true where the byte is none of the given ASCII characters."""
    flags = np.ones(256, dtype=bool)
    flags[[ord(c) for c in pattern_excludes]] = False
    return flags


#: Words `[^\x20\x09-\x0D]+`: all but ASCII white space.
NOT_SPACE = byte_class(" \t\n\x0b\x0c\r")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased: ASCII letters and digits and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def batch_slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch at row borders so that each part holds about ``limit`` bytes of text, or one longer text."""
    if not batch.num_rows:
        return
    offsets = _offsets(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the place where each begins (one more entry for the end)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    offsets = _offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest run of true flags; a run ends where its text ends."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1]
    ends[:-1] &= ~flags[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(flags))]
    begins[inner] = flags[inner]
    ends[inner - 1] = flags[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer: equal in, equal out, and every bit of the input reaches every bit of the output."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Hashes of any stretch of a byte array from running sums of a polynomial modulo 2**64."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        """``data``: bytes, or 64-bit hashes of words for stretches of words."""
        n = len(data)
        self._grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        # A value per byte that is far from linear in the byte, so that short texts spread as well.
        values = _BYTE_VALUES[data] if data.dtype == np.uint8 else mix(data)
        np.cumsum(values * Prefix._powers[:n], out=self.sums[1:])

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_powers", int(_MULTIPLIER)), ("_inverse", pow(int(_MULTIPLIER), -1, 1 << 64))):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(cls, name, np.multiply.accumulate(table))

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each stretch; equal bytes give equal hashes wherever they stand."""
        raw = (self.sums[ends] - self.sums[starts]) * Prefix._inverse[starts]
        return mix(raw ^ (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hash of the window of ``width`` bytes that starts at each place."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * Prefix._inverse[:n])


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of the first word at or after its beginning."""
    starts, ends = runs(keep[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def group_windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width`` words in a row inside one text, and the number of the word where it starts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for i in range(width):
        value = mix(value * _MULTIPLIER + hashes[i : i + n])
    ends_at = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + width <= ends_at)
    return value[at], at


def per_text(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the text that holds each of the words ``at``."""
    return np.searchsorted(first, at, side="right") - 1
