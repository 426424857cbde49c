from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tests.llm.data import edge_rows
from tidewatch.llm import quality, texts, token_files, tokens
from tidewatch.llm.anchors import anchors

from tests.llm.data import base_counts

PIECES = ["a", "b", "'s", "'", "ll", "re", " ", "  ", "\n", "\t", "1", "é", "!", "²", "ª", "×", " 'd", "x", "\x0b", "\x1c", "日", " "]


def random_texts(n: int, seed: int = 5) -> list:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(n)] + ["", None, " ", "<|endoftext|>", "a <|endoftext|>\n"]


def test_pieces_give_the_ids_of_the_whole_text():
    encoder = tokens.Encoder(tokens.default_path())
    cases = random_texts(3000) + [r[1] for r in edge_rows()]
    for _ in range(2):  # with nothing known, and with all pieces known
        ids, begin = encoder.encode(pa.array(cases, pa.string()))
        for i, case in enumerate(cases):
            assert ids[begin[i] : begin[i + 1]].tolist() == encoder.tokenizer.encode(case or "", add_special_tokens=False).ids
    assert encoder.id_bytes[ids].sum() == sum(len((c or "").encode()) for c in cases)


def test_an_encoder_that_forgets_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 10)
    encoder = tokens.Encoder(tokens.default_path())
    for seed in range(3):
        cases = random_texts(50, seed)
        ids, begin = encoder.encode(pa.array(cases, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [encoder.tokenizer.encode(c or "", add_special_tokens=False).ids for c in cases]


def test_base_counts():
    cases = random_texts(500) + [r[1] for r in edge_rows()] + ["a b c d e f a b c d e f a", "x\nx\n\nx \n y"]
    found = quality.Texts(pa.array(cases, pa.string())).counts()
    for i, case in enumerate(cases):
        assert tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base_counts(case)[:5]


def test_slices_hold_all_rows_and_respect_offsets():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "", "cc"] * 9)], ["text"]).slice(3, 30)
    parts = list(texts.batch_slices(batch, "text", 20))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist() and len(parts) > 3
    data, offsets = texts.text_bytes(batch.column(0))
    assert [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == [x or "" for x in batch.column(0).to_pylist()]


def test_every_long_string_holds_an_anchor_at_the_same_place_in_its_copies():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcde ") for _ in range(300))
    cases = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 200))) + passage + "zz" * rng.randint(0, 9) for _ in range(6)] + ["-" * 150, "ab"]
    data, offsets = texts.text_bytes(pa.array(cases))
    at, _ = anchors(texts.Prefix(data), offsets, 100, 28)
    places = set(at.tolist())
    for a, b in zip(offsets, offsets[1:]):
        for p in range(a, b - 99):
            assert any(q in places for q in range(p, p + 73))
    inside = [sorted(q - offsets[i] - cases[i].index(passage) for q in places if offsets[i] + cases[i].index(passage) + 100 <= q < offsets[i] + cases[i].index(passage) + 172) for i in range(6)]
    assert inside[0] and all(x == inside[0] for x in inside)


def test_token_file_round_trip_and_damage(tmp_path):
    path = f"file:{tmp_path}/x.zst"
    writer = token_files.Writer(path, 2, 2)
    documents = [np.arange(n) % 60_000 for n in (0, 1, 5, 100_000)]
    for d in documents:
        writer.add(d)
    writer.close()
    reader = token_files.Reader(path)
    assert [reader.ids(i).tolist() for i in (3, 0, 2, 1)] == [documents[i].tolist() for i in (3, 0, 2, 1)]
    reader.close()
    import zstandard

    with open(tmp_path / "x.zst", "rb") as f:  # any reader of the format skips the header and the table
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain == b"".join(d.astype("<u2").tobytes() for d in documents)
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    first = int(token_files.Reader(path)._begin[1])
    raw[first + 6] ^= 1
    (tmp_path / "y.zst").write_bytes(raw)
    broken = token_files.Reader(f"file:{tmp_path}/y.zst")
    assert broken.ids(2).tolist() == documents[2].tolist()
    try:
        broken.ids(1)
        raise AssertionError("the damage was not seen")
    except (ValueError, zstandard.ZstdError):
        pass
