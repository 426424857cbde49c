from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import data
from tidewatch.llm import (
    decontamination, entropy_mixing, kd_sharding, line_templates, parity_join, quality, substring_dedup, token_counts, token_files, tokens, url_filter,
)
from tidewatch.llm.common import ordered_rows
from tidewatch.llm.components import components


@pytest.fixture(scope="module")
def docs(spark):
    return data.edge_documents(spark).cache()


@pytest.fixture(scope="module")
def sample(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, data.ITEM), (2, None), (3, ""), (4, "a"), (1, "one two three"), (None, "error 17 at node"), (5, "Zz " * 12)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(1, 21)] + [(5, 0, 1), (999, 1, 0), (7, None, None), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1


def test_contamination(docs, sample, benchmark, spark, folder):
    for rows, items in ((docs, benchmark), (sample, spark.read.parquet(f"{folder}/benchmark.parquet"))):
        known = [(r["item_id"] if r["item_id"] is not None else "", r["text"]) for r in items.collect()]
        want = Counter((i, *data.contaminated_words(t, known)) for i, t in pairs(rows))
        assert Counter(map(tuple, decontamination.contamination(rows, items).collect())) == want


def test_longest_matches_and_blocks(docs, benchmark):
    one = decontamination.matches(docs, benchmark)
    many = decontamination.matches(docs, benchmark, block_bytes=20)
    key = lambda r: (str(r["doc_id"]), r["n_words"], sorted(map(str, r["matches"])))
    assert sorted(map(key, one.collect())) == sorted(map(key, many.collect()))
    found = {r["doc_id"]: r["matches"] for r in one.where("doc_id = 11").collect()}[11]
    assert [(m["item_id"], m["item_word"], m["word"], m["words"]) for m in found] == [("1", 0, 1, 18)]


def test_clean_documents_keep_all_columns(docs, benchmark):
    clean = decontamination.clean_documents(docs, benchmark)
    dirty = {(i, t) for i, t in pairs(docs) if data.contaminated_words(t, [(r[0] or "", r[1]) for r in benchmark.collect()])[4]}
    assert clean.schema.simpleString() == docs.schema.simpleString()
    assert Counter(pairs(clean)) == Counter(x for x in pairs(docs) if x not in dirty)
    assert decontamination.clean_documents(docs, benchmark.limit(0)).count() == docs.count()


# 2


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(docs, rule):
    encoder = tokens.Encoder(tokens.default_path())
    got = token_counts.section_tokens(docs.where("doc_id <> 4 or doc_id is null"), rule).collect()
    want = Counter()
    for i, text in pairs(docs.where("doc_id <> 4 or doc_id is null")):
        raw = (text or "").encode()
        begins = [p for p in range(len(raw)) if p == 0 or raw[p - 1] == 10 and raw[p] != 10] or [0]
        ends = [*begins[1:], len(raw)]
        counts, crossing, at = [0] * len(begins), [0] * len(begins), 0
        for token in encoder.tokenizer.encode(text or "", add_special_tokens=False).ids:
            n = int(encoder.id_bytes[token])
            parts = [min(e, at + n) - max(b, at) for b, e in zip(begins, ends)]
            touched = [k for k, x in enumerate(parts) if x > 0]
            k = {"start": touched[0], "end": touched[-1], "largest": max(touched, key=lambda k: (parts[k], -k))}[rule]
            counts[k], crossing[k], at = counts[k] + 1, crossing[k] + (len(touched) > 1), at + n
        want.update((i, k, begins[k], ends[k] - begins[k], counts[k], crossing[k]) for k in range(len(begins)))
    assert Counter(map(tuple, got)) == want


def test_allocation_rules():
    import numpy as np

    begins, ends = np.array([0, 4, 5]), np.array([4, 5, 9])
    spans = np.array([0, 3, 3]), np.array([3, 6, 9])
    assert [token_counts.allocate(*spans, begins, ends, r).tolist() for r in token_counts.RULES] == [[0, 0, 0], [0, 2, 2], [0, 0, 2]]


# 3


@pytest.mark.parametrize("whole_bucket", [20_000, 2])
def test_repeated_substrings(docs, sample, whole_bucket):
    for rows in (docs.where("doc_id <> 4 or doc_id is null"), sample):
        order = {(r["doc_id"], r["text"]): r["doc"] for r in ordered_rows(rows.select("doc_id", "text")).collect()}
        want = data.cut_repeats([(k, t) for (_, t), k in order.items()])
        got = substring_dedup.without_repeats(rows, whole_bucket=whole_bucket).drop("kept_text").collect()
        assert Counter(map(tuple, got)) == Counter((i, *want[order[i, t]]) for i, t in pairs(rows))


def test_repeats_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD_ROWS", 1)
    texts = [data.PROSE * 2, "x" + data.PROSE, "y" + data.PROSE + "z", data.PROSE[:150] + "--" + data.PROSE[40:], "ab " * 200, "q" * 99, "r" * 100, "r" * 101]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = data.cut_repeats(list(enumerate(texts)))
    assert {r[0]: tuple(r)[1:] for r in substring_dedup.without_repeats(rows, with_text=False).collect()} == want


def test_order_of_documents(docs):
    rows = sorted(((r["doc"], r["doc_id"], r["text"]) for r in ordered_rows(docs.select("doc_id", "text")).collect()), key=lambda r: r[0])
    ids = [r[1] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len({r[0] for r in rows}) == len(set(pairs(docs)))


# 4


def check_mix(rows, taken, weights=entropy_mixing.WEIGHTS):
    sizes, got, goal = Counter(), Counter(), {}
    for r in taken:
        assert r["copies"] in (0, 1, 2)
        sizes[r["source"]] += r["size"]
        got[r["source"]] += r["size"] * r["copies"]
        goal[r["source"]] = r["target"]
        assert r["source_size"] is not None
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s] * (1 + 1e-12)}
        if not over:
            break
        full |= over
    for s in names:
        assert goal[s] == pytest.approx(target[s])
        smallest = min((r["size"] for r in taken if r["source"] == s and r["size"]), default=0)
        assert abs(got[s] - target[s]) <= max(smallest, 1)


def test_mix(docs, sample):
    # Beside one text that is longer than all others of its source together, no rounding comes near the target.
    for rows in (docs.where("doc_id <> 4 or doc_id is null"), sample, docs):
        taken = entropy_mixing.mixed_copies(rows).collect()
        assert len(taken) == rows.count()
        if rows is not docs:
            check_mix(rows, taken)
        again = entropy_mixing.mixed_copies(rows.repartition(5)).collect()
        key = lambda r: (r["doc_id"], r["_text_hash"], r["copies"])
        assert Counter(map(key, taken)) == Counter(map(key, again))


def test_rates_are_tilted_by_size(spark):
    counts = spark.createDataFrame([("a", n, 10) for n in (10, 20, 40, 80)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 2000.0, 1500)], "source string, target double, source_size long")
    rates = {r["size"]: r["rate"] for r in entropy_mixing.solve_rates(counts, targets).collect()}
    import math

    assert sum(10 * s * r for s, r in rates.items()) == pytest.approx(2000)
    assert math.log(rates[20]) / math.log(rates[10]) == pytest.approx(2) and rates[80] <= 2


def test_mix_writes_documents_as_often_as_taken(docs):
    mixed = entropy_mixing.mix_documents(docs)
    assert mixed.schema.simpleString() == docs.schema.simpleString()
    want = Counter()
    for r in entropy_mixing.mixed_copies(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], len(data.SPACE_WORD.findall(r["text"]))) for r in mixed.collect())
    assert got == +want


# 5


def test_quality(docs, labels, sample, spark, folder):
    for rows, known in ((docs, labels), (sample, spark.read.parquet(f"{folder}/labels.parquet")), (docs, labels.limit(0))):
        got = quality.quality(rows, known).collect()
        assert Counter(tuple(r)[:7] for r in got) == Counter((i, *data.base_counts(t)) for i, t in pairs(rows))
        assert all(r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5) for r in got)
        good = quality.good_documents(rows, known)
        assert good.schema.simpleString() == rows.schema.simpleString()
        assert Counter(r["doc_id"] for r in good.collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(2))
    got = quality.quality(docs, labels.where(part == 0)).join(labels.where(part == 1), "doc_id").where(~F.col("base_failed")).collect()
    assert len(got) > 1000
    for label in (0, 1):
        mine = [r["kept"] == bool(label) for r in got if r["quality"] == label]
        assert sum(mine) >= 0.95 * len(mine)


# 6


def test_token_files(docs):
    encoder = tokens.Encoder(tokens.default_path()).tokenizer
    index = token_files.write_tokens(docs)
    back = token_files.with_starts(token_files.read_tokens(index)).orderBy("start").collect()
    assert [r["start"] for r in back] == [sum(x["n_tokens"] for x in back[:i]) for i in range(len(back))]
    assert [(i is not None, i or 0) for i in (r["doc_id"] for r in back)] == sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in back)
    want = Counter((i, *encoder.encode(t or "", add_special_tokens=False).ids, 2) for i, t in pairs(docs))
    assert Counter((r["doc_id"], *r["ids"]) for r in back) == want
    import numpy as np

    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in back)
    some = token_files.read_tokens(index.where("doc_id in (9, 14)")).collect()
    assert {r["doc_id"] for r in some} == {9, 14}


# 7


def test_urls(spark):
    urls = [
        None, "", "no scheme/net/es/", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "ftp://example.com", "http://example.com?en/",
        "http://x.net/es/a", "http://net/fr/", "http://xnet/fr/", "HTTP://Ünïcode.COM/fr/é", "http://a.www.example.com/en/b\nc", "http://h/p://q/net/es/",
        "https://best-casino-bonus.example.org/en/1", "https://green-garden.example.org/en/1", "http://sub.example.com/enx",
    ]
    rows = spark.createDataFrame([(i, u, "page", "x") for i, u in enumerate(urls)] + [(3, urls[3], "page", "x")], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(rows).collect()}
    assert url_filter.judge_urls(rows).count() == len(urls) + 1
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].translate(lower), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        assert (got[i]["host"], got[i]["path"]) == (host, path), url
        assert got[i]["rule"] == (max(fits)[1] if fits else None), url
        assert got[i]["verdict"] == (max(fits)[2] if fits else "block" if got[i]["p_block"] > 0.5 else "allow")
    assert got[13]["verdict"] == "block" and got[14]["verdict"] == "allow"


def test_urls_without_a_model(spark):
    rows = spark.createDataFrame([(1, "http://casino.example.org/en/")], "page_id long, url string")
    none = spark.createDataFrame([("http://a.org/", 0.0)], "url string, y double")
    assert [r["verdict"] for r in url_filter.judge_urls(rows, labelled=none).collect()] == ["allow"]


# 8


@pytest.mark.parametrize("width,p", [(4, 85), (5, 80)])
def test_near_duplicates(docs, spark, width, p):
    made = spark.createDataFrame(variants(), "doc_id long, text string").repartition(3)
    for rows in (docs, made):
        name = data.linked_components([x for x in pairs(rows) if x[0] is not None], width, p)
        got = parity_join.near_duplicates(rows, width, (p, 100)).collect()
        assert Counter(tuple(r)[:2] for r in got) == Counter((i, len(data.shingles(t, width))) for i, t in pairs(rows))
        empty = {i for i, t in pairs(rows) if not data.shingles(t, width)}
        for r in got:
            if r["doc_id"] is not None and r["doc_id"] not in empty:
                assert r["component_id"] == name[r["doc_id"]]
        assert all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)


def variants() -> list[tuple]:
    """Families of texts with a growing number of changed words, of all sizes, so that similarities lie around the bound."""
    import random

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 13, 16, 20, 30, 60, 120, 250, 400]:
        base = [rng.choice(vocabulary) for _ in range(size)] + (shared if size > 12 else [])
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 1 + size // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                words = words + [rng.choice(vocabulary) for _ in range(rng.randint(0, 1 + size // 10))]
            out.append((len(out) * 7 % 1009, " ".join(words)))
    return out


def test_streamed_groups_in_small_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(parity_join, "HELD_ROWS", 3)
    groups = {1: [5], 2: [4, 4, 4], 3: [1, 2], 4: list(range(20)), 9: [3, 7, 8], 12: [1, 1, 6]}
    rows = [(k, c) for k, members in groups.items() for c in members]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[a : a + 4]], pa.int64()) for i in (0, 1)], ["key", "c1"]) for a in range(0, len(rows), 4)]
    out = [r for b in parity_join._stars(iter(batches)) for r in b.to_pylist()]
    want = {(members[0], m) for members in groups.values() for m in members if m != members[0]}
    assert {(r["a"], r["b"]) for r in out if r["a"] != r["b"]} == want
    have = defaultdict(set)
    for r in out:
        if r["a"] == r["b"]:
            have[r["key"]].add(r["a"])
    assert {k for k in have} == {4, 9} and np.all([m in have[9] for m in groups[9]])
    assert have[4] == set(groups[4])


def test_every_member_of_a_held_group_is_listed(monkeypatch):
    import pyarrow as pa

    for held in (1, 2, 3):
        monkeypatch.setattr(parity_join, "HELD_ROWS", held)
        for step in (1, 2, 3, 4):
            rows = [(10, m) for m in (10, 20, 30, 40, 50)] + [(11, 1), (11, 2)] + [(12, m) for m in range(7)]
            batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[a : a + step]], pa.int64()) for i in (0, 1)], ["key", "c1"])
                       for a in range(0, len(rows), step)]
            listed = defaultdict(set)
            for b in parity_join._stars(iter(batches)):
                for r in b.to_pylist():
                    if r["a"] == r["b"]:
                        listed[r["key"]].add(r["a"])
            assert listed == {10: {10, 20, 30, 40, 50}, 12: set(range(7))}


def test_blocks_leave_no_pair_out(spark, monkeypatch):
    """Many texts that share passages: groups larger than a block, whose members are linked, just not linked, or far apart."""
    import random

    monkeypatch.setattr(parity_join, "BLOCK_ROWS", 5)
    rng = random.Random(8)
    rows = []
    for family in range(4):
        base = [f"w{family}x{i}" for i in range(80)]
        for k in range(30):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(80)] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in parity_join.near_duplicates(docs).collect()}
    assert got == data.linked_components(rows, 4, 85)
    kept, close = [], []
    monkeypatch.setattr(parity_join, "_verified", lambda pairs, *a: kept.append(pairs.count()) or pairs.limit(0))
    parity_join.near_duplicates(docs)
    monkeypatch.setattr(parity_join, "BLOCK_ROWS", 1000)
    parity_join.near_duplicates(docs)
    assert kept[1] == kept[3] > 0  # blocks of any size find the same pairs


def test_members_go_to_blocks_with_a_quarter_of_their_sketch(spark, monkeypatch):
    """Sketches are in no row before its block is known, then folded; what is ruled out by whole sketches is not verified."""
    import numpy as np
    import pyarrow as pa

    sets = parity_join.Sets(pa.array([" ".join(f"w{i}" for i in range(first, first + 900)) for first in (0, 20, 450)] + ["a b c d e"]))
    wide = sets.wide_sketches()
    slim = [parity_join._slim(w) for w in wide]
    assert [len(w) for w in wide] == [512, 512, 512, 64] and [len(w) for w in slim] == [128, 128, 128, 64]
    apart = lambda x, y: int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum())
    for i, j, differ in [(0, 1, 40), (1, 2, 860), (0, 2, 900)]:
        assert apart(slim[i], slim[j]) <= apart(wide[i], wide[j]) <= differ
    assert apart(slim[0], slim[2]) > 2 * 897 * 15 // 185  # still tells sets apart that are not similar
    seen = []
    in_blocks = parity_join._in_blocks
    monkeypatch.setattr(parity_join, "_in_blocks", lambda *given: seen.append(given[:2]) or in_blocks(*given))
    words = [f"w{i}" for i in range(900)]
    docs = spark.createDataFrame([(k, " ".join(words[k * 60 : k * 60 + 600])) for k in range(6)], "doc_id long, text string")
    parity_join.near_duplicates(docs)
    (rest, details), = seen
    assert set(rest.columns) == {"key", "hash", "component"}
    assert {len(r["slim"]) for r in details.collect()} == {128}




def test_one_of_each(docs):
    kept = parity_join.one_of_each(docs, 5, (80, 100))
    assert kept.schema.simpleString() == docs.schema.simpleString()
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[5] == 1 and ids[6] == ids[10] == 0 and ids[None] == 2 and all(ids[i] == 1 for i in (1, 2, 7, 8, 9))


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (200, 300), (200, 400), (400, 500)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == 99 and {got[i] for i in (200, 300, 400, 500)} == {200}


# 9


@pytest.mark.parametrize("shards", [16, 5])
def test_shards(docs, sample, shards):
    for rows in (docs, sample):
        got = kd_sharding.shard_documents(rows, shards).collect()
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(rows))
        assert Counter(tuple(r)[:3] for r in got) == want and {r["law"] for r in got} == {"bytes"}
        slots, sizes = defaultdict(list), Counter()
        for r in got:
            slots[r["shard"]].append(r["slot"])
            sizes[r["shard"]] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
        largest = max(r["size"] for r in got)
        mean = sum(sizes.values()) / shards
        assert all(abs(sizes[i] - mean) <= 2 * largest for i in range(shards))


def test_shards_of_one_hot_value(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    got = Counter(r["shard"] for r in kd_sharding.shard_documents(rows).collect())
    assert len(got) == 16 and max(got.values()) - min(got.values()) <= 16


# 10


def test_line_templates(docs, sample):
    for rows in (docs.where("doc_id <> 4 or doc_id is null"), sample):
        least = 3
        order = {(r["doc_id"], r["text"]): r["doc"] for r in ordered_rows(rows.select("doc_id", "text")).collect()}
        want = data.template_lines([(k, t) for (_, t), k in order.items()], line_templates.DEPTH, line_templates.SIMILARITY, least)
        got = line_templates.without_recurring_lines(rows, least).collect()
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in got) == Counter((i, *want[order[i, t]]) for i, t in pairs(rows))
    left = {r["doc_id"]: r["kept_text"] for r in line_templates.without_recurring_lines(docs, 3).collect()}
    assert left[16] == "own line here" and left[13] == "" and left[14] == "one two three" and left[8] == "\n\n \n"


# empty tables


def test_empty_tables(spark, labels, benchmark):
    none = data.no_documents(spark)
    assert decontamination.contamination(none, benchmark).count() == 0
    assert decontamination.clean_documents(none, benchmark).count() == 0
    assert token_counts.section_tokens(none).count() == 0
    assert substring_dedup.without_repeats(none).count() == 0
    assert entropy_mixing.mixed_copies(none).count() == 0 and entropy_mixing.mix_documents(none).count() == 0
    assert quality.quality(none, labels).count() == 0 and quality.good_documents(none, labels).count() == 0
    assert token_files.token_digest(none).count() == 0
    assert parity_join.near_duplicates(none).count() == 0 and parity_join.one_of_each(none).count() == 0
    assert kd_sharding.shard_documents(none).count() == 0
    assert line_templates.without_recurring_lines(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(pages).count() == 0
