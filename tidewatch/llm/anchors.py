"""Anchors: places of a text picked by content, so that every long enough string holds one at the same place in all its copies."""

from __future__ import annotations

import numpy as np

from .texts import Prefix


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each stretch of ``width`` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


def anchors(prefix: Prefix, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the q-grams of ``gram`` bytes that are the least, by hash, in some string of ``length`` bytes.

    Strings do not reach over the end of a text. Every string of ``length`` bytes holds an anchor.
    """
    grams = prefix.windows(gram)
    width = length - gram + 1
    n = len(grams) - width + 1  # number of strings
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(grams, width, np.minimum)
    # Strings that reach into the next text do not count; 0 is below every hash but one.
    room = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n)
    least[room < length] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == grams)
    at = at[grams[at] != 0]
    return at, grams[at]
