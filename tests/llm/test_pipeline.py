"""The corpus pipeline against plain versions of its stages, and on odd and empty tables."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import data
from tidewatch.llm import entropy_mixing, tokens

LABELS = "doc_id long, quality int, toxic int"


def tables(spark, folder, docs, labels=None, benchmark=None):
    none = spark.createDataFrame([], LABELS)
    docs.write.parquet(f"{folder}/documents.parquet")
    (none if labels is None else labels).write.parquet(f"{folder}/labels.parquet")
    (spark.createDataFrame([], "item_id long, text string") if benchmark is None else benchmark).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def kept_by_rules(rows, items):
    """Documents that pass the base rules, are the first of their group and hold no window of an item."""
    good = [(i, t) for i, t in rows if not data.base_counts(t)[-1]]
    component = data.linked_components([(i, t) for i, t in good if i is not None], 5, 80)
    single = [(i, t) for i, t in good if i is None or component[i] == i or not data.shingles(t, 5)]
    once = {(i, t) if i is None else i: (i, t) for i, t in single}.values()
    return [(i, t) for i, t in once if not data.contaminated_words(t, items)[-1]]


def test_stages_together(spark, folder, tmp_path):
    """Without labels the classifier keeps what passes the rules, so that every stage has a plain version."""
    given = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    place = tables(spark, tmp_path / "t", given, benchmark=benchmark)
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    expected = kept_by_rules(rows, [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert 0 < len(expected) < len(rows)
    ids = spark.createDataFrame([(i,) for i, _ in expected], "doc_id long")
    copies = {r["doc_id"]: r["copies"] for r in entropy_mixing.mixed_copies(given.join(ids, "doc_id", "left_semi")).collect()}
    got = corpus_pipeline.run(spark, place).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({i: c for i, c in copies.items() if c})
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(tokens.default_path()), dict(rows)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_odd_and_empty_tables(spark, tmp_path, kind):
    docs = data.edge_documents(spark) if kind == "odd" else data.no_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 21)] + [(None, 1, 0), (5, None, None)], LABELS)
    benchmark = spark.createDataFrame([(1, data.ITEM), (None, None), (3, "")], "item_id long, text string")
    place = tables(spark, tmp_path / "t", docs, labels if kind == "odd" else None, benchmark if kind == "odd" else None)
    table = spark.read.parquet(f"{place}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, table, place)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.schema.simpleString() == docs.schema.simpleString()
            known = {(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()}
            after.write.parquet(f"{place}/{name.replace(' ', '-').replace('/', '-')}.parquet")
            table = spark.read.parquet(f"{place}/{name.replace(' ', '-').replace('/', '-')}.parquet")
            left = {(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()}
            assert left <= known and (left if kind == "odd" else not left)
            assert kind == "empty" or "contamination" not in name or not any(data.ITEM in (t or "") for _, t in left)
    assert after.count() == table.count()
