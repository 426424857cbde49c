from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import data, plain_new
from tidewatch.llm import conversation_repair, forced_boundaries, spelling_variants
from tidewatch.llm.conversation_grammar import START, Evaluated, Grammar, ending

CONVERSATION = "conv_id long, turn long, role string, text string, at long, piece long, audit string, _kind int"


@pytest.fixture(scope="module")
def docs(spark):
    return data.edge_documents(spark).cache()


@pytest.fixture(scope="module")
def sample(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").cache()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 11


def odd_conversations():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sam", "unit"]
    texts = ["Fine.", "What?", "cut off", "", None, " \t\n", "Yes!  ", "é 日本.", "no end ,", "Fine.", "long " * 3000 + "."]
    rows = [(i, rng.choice([0, 1, 2, 3, 4, 9, None]), rng.choice(roles), rng.choice(texts)) for i in range(80) for _ in range(rng.randrange(1, 9))]
    rows += [(None, t, r, "Hello.") for t, r in ((None, "user"), (None, "user"), (2, "assistant"), (None, None))]
    rows += [(500, t, ["user", "assistant"][t % 2], f"Turn {t}" + rng.choice([".", "", "?"])) for t in range(300)]
    rows += [(501, 7, "user", "Same again.")] * 200
    return [(*r, 7, 7, "m", 7) for r in rows]


def same_report(spark, rows, monkeypatch, fragment):
    monkeypatch.setattr(conversation_repair, "FRAGMENT_ROWS", fragment)
    table = spark.createDataFrame(rows, CONVERSATION).repartition(3)
    plain = [r[:4] for r in rows]
    made = conversation_repair.damaged(table)
    want = plain_new.damaged_rows(plain)
    assert Counter(map(tuple, made.where("not dropped").select("conv_id", "turn", "role", "text").collect())) == Counter(want)
    report = conversation_repair.repair_report(made.where("not dropped"), made.where("dropped"))
    got = {r["conv_id"]: tuple(r)[1:] for r in report.collect()}
    assert got == plain_new.repair_report(want, {r[0] for r in plain})


@pytest.mark.parametrize("fragment", [4096, 8])
def test_repair_of_odd_conversations(spark, monkeypatch, fragment):
    same_report(spark, odd_conversations(), monkeypatch, fragment)


def test_repair_of_given_conversations(spark, folder, monkeypatch):
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    same_report(spark, [(*r, 7, 7, "m", 7) for r in table.select("conv_id", "turn", "role", "text").collect()], monkeypatch, 4096)


def test_repair_of_nothing(spark):
    table = spark.createDataFrame([], CONVERSATION)
    assert conversation_repair.repair_report(table).count() == 0
    made = conversation_repair.damaged(table)
    assert conversation_repair.repair_report(made.where("not dropped"), made.where("dropped")).count() == 0
    lost = spark.createDataFrame([(3,)], "conv_id long")
    row = conversation_repair.repair_report(table, lost).collect()[0]
    assert tuple(row) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_are_in_form(spark):
    rows = odd_conversations()
    table = spark.createDataFrame(rows, CONVERSATION)
    turns = conversation_repair.repaired_turns(table)
    initials = {}
    for r in turns.orderBy("conv_id", "place").collect():
        initials[r["conv_id"]] = initials.get(r["conv_id"], "") + r["role"][0]
    import re

    assert all(re.fullmatch("(s?(ua)+)?", x) for x in initials.values()) and len(initials) > 40
    report = {r["conv_id"]: r["audit"] for r in conversation_repair.repair_report(table).collect()}
    edits = {}
    for r in turns.orderBy("conv_id", "place").collect():
        edits[r["conv_id"]] = edits.get(r["conv_id"], "") + r["edit"]
    assert {i: a.replace("D", "") for i, a in report.items() if a.replace("D", "")} == edits


def test_grammar_shrinks_and_agrees_with_single_rows():
    rng = np.random.default_rng(5)
    sequences = [rng.integers(0, 16, rng.integers(1, 60)) for _ in range(200)] + [np.full(1000, 5), np.tile([4, 8], 700)]
    flat, offsets = np.concatenate(sequences).astype(np.int64), np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    bare, grammar = Grammar(), Grammar()
    now, at = flat, offsets
    for _ in range(8):
        pair, n = np.unique((now[:-1] << 32) | now[1:], return_counts=True)
        top = pair[np.argsort(-n, kind="stable")][:40]
        grammar.add([(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in top])
        now, at = grammar.compress(now, at, len(grammar.rounds) - 1)
    a, b = Evaluated(bare, flat, offsets), Evaluated(grammar, flat, offsets)
    assert len(b.flat) < 0.6 * len(flat) and np.array_equal(a.cost, b.cost) and np.array_equal(a.rank, b.rank)
    for i in range(len(sequences)):
        _, last, _ = ending(a.cost[i, START], a.rank[i, START])
        assert a.letters(i, START, last) == b.letters(i, START, last)


# 12


def test_ids_are_those_of_the_library(docs, sample):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(forced_boundaries.default_path())

    def plain(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        whole = library.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest()

    for rows in (docs, sample):
        want = Counter((i, *plain(t)) for i, t in pairs(rows))
        assert Counter(map(tuple, forced_boundaries.coding_digest(rows).collect())) == want
    assert forced_boundaries.coding_digest(docs.limit(0)).count() == 0
    back = forced_boundaries.decoded(forced_boundaries.encoded(docs))
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in pairs(docs))


def test_random_texts_and_blocks():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(forced_boundaries.default_path()), forced_boundaries.coder(forced_boundaries.default_path())
    rng = random.Random(12)
    bits = ["a", "b", "'s", "'", "'re ", "'ll", "  ", " ", "\n", "\t", " ", "　", "é", "日本", "1", "²", "!", "<|endoftext|>", "<|endof", "the ", "😀", "́",
            "zq", "'S", "don't", "''s", "\x1c", "\x85", "​", "ǅ", "x" * 50, "\xa0", "??", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]
    column = pa.array(texts)
    ids, first = own.encode(*forced_boundaries.text_bytes(column))
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[k] : first[k + 1]].tolist() == e.ids, texts[k]
        assert own.decode_text(np.array(e.ids, np.int64)) == library.decode(e.ids, skip_special_tokens=False)
    whole = " ".join(texts)
    raw = np.frombuffer(whole.encode(), np.uint8)
    cut = list(forced_boundaries.blocks(raw, list(own.added), 1000))
    assert len(cut) > 20 and np.array_equal(np.concatenate(cut), raw)
    joined = np.concatenate([own.encode(b, np.array([0, len(b)]))[0] for b in cut])
    assert joined.tolist() == library.encode(whole, add_special_tokens=False).ids
    some = [[rng.randrange(50257) for _ in range(rng.randrange(9))] for _ in range(500)]
    assert all(own.decode_text(np.array(x, np.int64)) == library.decode(x, skip_special_tokens=False) for x in some)


def test_a_long_text_is_worked_off_in_blocks(spark):
    from tokenizers import Tokenizer

    text = ("wörter und <|endoftext|> 12 Zahlen,  Lücken\n\n und mehr " * 30_000)[:-1]
    row = forced_boundaries.coding_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    ids = Tokenizer.from_file(forced_boundaries.default_path()).encode(text, add_special_tokens=False).ids
    assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# 13


def test_variants(docs, sample, spark):
    words = ["colour", "color", "colours", "colouur", "Colour", "cloour", "naïve", "naive", "näive", "aaaaa", "aaaaaa", "aaaaaaa", "ähre×", "ährex", "xährex"]
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=60)), "en", "s", 0) for i in range(30)]
    rows += [(None, "colour " * 4, None, None, 0), (None, None, None, None, 0), (2, "x" * 3000 + " " + "x" * 2999 + " ", "en", None, 0)] * 3
    odd = spark.createDataFrame(rows, "doc_id long, text string, word string, signature string, n int")
    for table, one_in in ((odd, 97), (odd, 5), (sample, 97), (docs, 97)):
        got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants.spelling_variants(table, one_in=one_in).collect()}
        assert got == plain_new.variants(pairs(table), one_in)
    assert spelling_variants.spelling_variants(odd.limit(0)).count() == 0


def test_every_edit_shares_a_signature():
    rng = random.Random(14)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(5, 12)))
        i, c = rng.randrange(len(a)), rng.choice("abcdü")
        for b in (a[:i] + a[i + 1 :], a[:i] + c + a[i:], a[:i] + c + a[i + 1 :]):
            if a == b or len(b) < 1:
                continue
            short, long = sorted((a, b), key=len)
            signed = [(role, int(s[0]), int(s[1])) for role, _, s in spelling_variants.word_signatures(pa.array([short, long]))]
            role_of_long = int(len(long) > len(short))
            mine, other = {s for r, s, _ in signed if r == 0}, {t for r, _, t in signed if r == role_of_long}
            assert mine & other, (short, long)


def test_a_common_stretch_does_not_add_links(spark):
    rows = [(i, (f"prefix{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}suffix ") * 3) for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r["n_near"] for r in spelling_variants.spelling_variants(table, one_in=10**9).collect()}
    assert got == {w: v[3] for w, v in plain_new.variants(rows, 10**9).items()}
