"""Small documents with every odd case, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PROSE = (
    "the old harbour lay still that morning and nobody on the quay could say when the first boat had come in "
    "though everyone agreed that it must have been well before the light because the ropes were already dry "
)
ITEM = "which of these seven rivers flows north past the twin cities before it turns towards the inland sea"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars int, kept boolean, n_words long, size string, key long, doc long, "
    "component long, at long, matches string, template long"
)


def edge_rows() -> list[tuple]:
    long_text = " ".join(f"word{i % 9973}" for i in range(40_000)) + " Größe naïve 日本語 " + "\n".join(["same line again and again"] * 500)
    texts = [
        (1, None, "en", None), (2, "", None, "b"), (3, "a", "en", "b"), (4, long_text, "en", "b"), (5, PROSE + "Five.", "en", "c"),
        (6, PROSE + "Five.", "en", "c"), (6, PROSE + "Five.", "en", "c"), (7, "x" * 5000, "de", "c"), (8, "\n\n \n", "de", None),
        (None, PROSE + "no id", "en", "a"), (None, None, None, None), (9, "ends <|endoftext|> here 日本 it's 'tis", "en", "a"),
        (3, "another text with the same id as before " + ITEM, "en", "a"), (10, PROSE.upper() + "FIVE.", "en", "a"),
        (11, "intro " + ITEM.replace(" ", ", ") + " outro", "en", "a"), (12, PROSE * 3, "en", "b"), (13, "Error 17 at node 5: retry", "en", "b"),
        (14, "one two three", "en", "b"), (15, "one  two\tthree", "en", "b"), (16, "Error 18 at node 6: retry\nown line here", "en", "b"),
        (17, "Error 19 at node 7: retry", "en", "b"), (18, "Error 20 at node 8: retry\n", "en", "b"), (19, "Error 21 at node 9: abort", "en", "b"),
        (20, PROSE * 3 + " tail", "en", "b"),
    ]
    return [(i, t, lang, source, len(t or ""), None, -1, "size", 7, 7, 7, 7, "m", 7) for i, t, lang, source in texts]


def edge_documents(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None, width: int) -> set:
    words = SPACE_WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def linked_components(rows: list[tuple], width: int, p: int) -> dict:
    """(id, text) -> smallest id reachable, comparing all pairs."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingles(t, width))
    ids = sorted(sets)
    name = {i: i for i in ids}
    links = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= p * len(x | y) for x in sets[a] for y in sets[b]):
                links.add((a, b))
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(name[a], name[b])
            moved |= name[a] != least or name[b] != least
            name[a] = name[b] = least
    return name


def cut_repeats(rows: list[tuple], length: int = 100) -> dict:
    """(order key, text) -> bytes, removed bytes, spans, digest of the rest, looking every string up in all before."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        spans = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def base_counts(text: str | None) -> tuple:
    text = text or ""
    words = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n)


def contaminated_words(text: str | None, items: list[tuple]) -> tuple:
    words = PLAIN_WORD.findall((text or "").translate(UPPER))
    hit, names = set(), set()
    for item, item_text in items:
        own = PLAIN_WORD.findall((item_text or "").translate(UPPER))
        width = min(10, len(own))
        windows = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)} if own else set()
        for i in range(len(words) - width + 1):
            if tuple(words[i : i + width]) in windows:
                hit |= set(range(i, i + width))
                names.add(str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def template_lines(rows: list[tuple], depth: int, similarity: float, least: int) -> dict:
    """(doc, text) -> lines and dropped lines, by the rules of the template tree on words instead of hashes."""
    mask = lambda w: "<*>" if re.search("[0-9]", w) else w
    parsed = {d: [tuple(map(mask, SPACE_WORD.findall(x))) for x in (t or "").split("\n") if SPACE_WORD.search(x)] for d, t in rows}
    leaf_of = lambda line: (len(line), line[:depth])
    docs_of, lines_of = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for d, lines in parsed.items():
        for line in lines:
            docs_of[leaf_of(line)].add(d)
            lines_of[leaf_of(line)][line].add(d)
    template = {}
    for leaf, lines in lines_of.items():
        constants = None
        if len(docs_of[leaf]) >= least and len(lines) > 1:
            constants = []
            for j in range(leaf[0]):
                counts = Counter()
                for line, docs in lines.items():
                    counts[line[j]] += len(docs)
                word, top = max(counts.items(), key=lambda x: x[1])
                constants.append(word if 2 * top >= sum(counts.values()) else "<*>")
        for line in lines:
            same = constants and sum(a == b != "<*>" for a, b in zip(line, constants)) >= similarity * len(line)
            template[line] = ("leaf", leaf) if same else ("line", line)
    docs = defaultdict(set)
    for d, lines in parsed.items():
        for line in lines:
            docs[template[line]].add(d)
    return {d: (len(lines), sum(len(docs[template[x]]) >= least for x in lines)) for d, lines in parsed.items()}
