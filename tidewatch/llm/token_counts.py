"""Token counts per section of a document by offset mapping.

A document is encoded once, whole. The bytes that each token stands for give its span in the text; the spans are
joined with the spans of the document's sections by binary search, and a token that crosses a border is allocated by
a rule: ``start`` (the section of its first byte), ``end`` (that of its last byte) or ``largest`` (the section that
holds most of its bytes, the earlier one of equals). Every token is counted exactly once.

Sections here are paragraphs: lines up to and with their line feeds, so they cover the text without gaps.

Defined cases: a null or empty text has one section without bytes or tokens; a text that ends in line feeds has no
section behind them; repeated documents have repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .texts import batch_slices, text_bytes
from .tokens import default_path, encoder

RULES = ("start", "end", "largest")


def sections(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each section begins, and the text that it belongs to; every text has one at least."""
    after = np.flatnonzero(data[:-1] == 0x0A) + 1
    # Line feeds in a row belong to the section before them.
    after = after[data[after] != 0x0A]
    begins = np.unique(np.concatenate([after, offsets[:-1][np.diff(offsets) > 0]]))
    text = np.searchsorted(offsets, begins, side="right") - 1
    empty = np.flatnonzero(np.diff(offsets) == 0)
    begins, text = np.concatenate([begins, offsets[empty]]), np.concatenate([text, empty])
    order = np.argsort(text, kind="stable")
    return begins[order], text[order]


def allocate(token_begin: np.ndarray, token_end: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """The number of the section that each token counts for. Sections are given in order and do not overlap."""
    first = np.searchsorted(begins, token_begin, side="right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(begins, token_end - 1, side="right") - 1
    if rule == "end":
        return last
    best, size = first.copy(), np.minimum(ends[first], token_end) - token_begin
    for step in range(1, int((last - first).max(initial=0)) + 1):
        here = np.flatnonzero(first + step <= last)
        section = first[here] + step
        part = np.minimum(ends[section], token_end[here]) - begins[section]
        better = part > size[here]
        best[here[better]], size[here[better]] = section[better], part[better]
    return best


def section_tokens(docs: DataFrame, rule: str = "start", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, section, first_byte, n_bytes, n_tokens, n_crossing): one row per section, numbered from 0.

    ``n_crossing`` counts those of the section's tokens that reach into another section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = vocabulary or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        for batch in batches:
            for part in batch_slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                ids, first = tokenizer.encode(part.column("text"))
                token_end = np.cumsum(tokenizer.id_bytes[ids])
                if not np.array_equal(np.concatenate([[0], token_end])[first], offsets):
                    raise ValueError("the tokens of a text do not add up to its bytes")
                token_begin = token_end - tokenizer.id_bytes[ids]
                begins, text = sections(data, offsets)
                ends = np.append(begins[1:], offsets[-1])
                # Empty texts have no tokens; their sections would only stand in the way of the search.
                real = np.flatnonzero(ends > begins)
                to = real[allocate(token_begin, token_end, begins[real], ends[real], rule)] if len(ids) else np.zeros(0, np.int64)
                crossing = (token_begin < begins[to]) | (token_end > ends[to])
                n = len(begins)
                number = np.arange(n) - np.searchsorted(text, text, side="left")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(text)), pa.array(number), pa.array(begins - offsets[text]), pa.array(ends - begins),
                     pa.array(np.bincount(to, minlength=n).astype(np.int64)), pa.array(np.bincount(to[crossing], minlength=n).astype(np.int64))],
                    ["doc_id", "section", "first_byte", "n_bytes", "n_tokens", "n_crossing"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {kind}, section bigint, first_byte bigint, n_bytes bigint, n_tokens bigint, n_crossing bigint")


def op2_section_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return section_tokens(documents(spark, folder))
