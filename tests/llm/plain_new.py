"""Plain versions of conversation repair, encoding and spelling variants."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

from tests.llm.data import UPPER

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def damaged_rows(rows):
    """Damaged (conv_id, turn, role, text) and all ids."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def order_key(row):
    return (row[1] is not None, row[1] or 0, row[2], row[3])


def repaired(rows):
    """Report of one conversation's rows in order, looking at every way to edit them."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        faults.append(fault)
        seen.add((role, text))
    step = lambda state, r: {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, r))

    @lru_cache(None)
    def best(i, state, inserts):
        """Cheapest (cost, audit, repaired rows) from row i on."""
        options = [(0, "", ())] if i == len(rows) and state in "0a" else []
        due = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        if inserts < 3:
            c, a, r = best(i, step(state, due), inserts + 1)
            options.append((c + 5, "I" + a, ((name, ""), *r)))
        if i < len(rows):
            role, text = rows[i][2:]
            c, a, r = best(i + 1, state, 0)
            options.append((c + 2, "D" + a, r))
            if faults[i] in ("", "truncated"):
                extra = 5 if faults[i] else 0
                c, a, r = best(i + 1, step(state, due), 0)
                options.append((c + 1 + extra, "R" + a, ((name, text), *r)))
                if step(state, role[:1]):
                    c, a, r = best(i + 1, step(state, role[:1]), 0)
                    options.append((c + extra, "K" + a, ((role, text), *r)))
        return min(options, key=lambda x: x[:2], default=(10**9, "", ()))

    for i in range(len(rows), 0, -1):  # from behind, so that no call goes deep
        for state in "0sua":
            best(i, state, 0)
    cost, audit, kept = best(0, "0", 0)
    turns = {r[1] for r in rows} - {None}
    count = Counter(faults)
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)


def repair_report(rows, ids=()):
    held = defaultdict(list)
    for i in ids:
        held[i]
    for r in rows:
        held[r[0]].append(r)
    return {i: repaired(sorted(x, key=order_key)) for i, x in held.items()}


def vocabulary(rows, one_in=97):
    n = Counter()
    for doc, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variants(rows, one_in=97):
    """Compares every word with all others of nearly its length."""
    n = vocabulary(rows, one_in)
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    form, near = {}, {}
    for w in n:
        close = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if one_edit(w, v)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], near[w], n[form[w]] if form[w] is not None else None)
    return out
