"""SQL of another engine for the queries that it can express on the given tables."""

from __future__ import annotations

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

BENCHMARK_SUFFIX_SEARCH = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+'), []) AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark
), bw AS (
  SELECT item, n, list_aggregate(ws[i : i + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, i, n, list_aggregate(ws[i : i + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), hits AS (
  SELECT DISTINCT doc_id, i, n, item FROM dw JOIN bw USING (n, win)
), words AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

PARITY_SKETCH_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_aggregate(ws[i : i + 3], 'string_agg', ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id
"""

_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(1, 9)), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c
    FROM (SELECT unnest(range(0, 256)) AS n))
)"""


def _crc32(text: str) -> str:
    """SQL of the crc32 of a string's UTF-8 bytes, with the column ``t`` of ``crc_table`` at hand."""
    byte = f"CAST(concat('0x', substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode({text}))), lambda i: {byte})), "
            "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)")


def _least(options: list[str]) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def _step(state: str, cost: int, audit: str) -> str:
    """A state's cheapest edits with one more edit; null where the state cannot be reached."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{audit}'}} END"


def _edited(state: str, edit: str, cost: int, condition: str) -> str:
    return f"CASE WHEN {condition} AND {state} IS NOT NULL THEN {{'c': {state}.c + {cost} + late, 'a': {state}.a || '{edit}'}} END"


def _conversation_repair() -> str:
    """States n(othing), s(ystem), u(ser), a(ssistant); inserts come before a row (or behind the last), then the row's own edit.

    Rows of one audit need no tie-break by text: the audit says which rows stay, and the order which roles they have.
    """
    # An insert leads n, s, a to u and u to a. The states after any inserts, by those before:
    after = {"n0": "n", "s0": "s", "u0": _least(["u", _step("n", 5, "I"), _step("s", 5, "I"), _step("a", 5, "I")]),
             "a0": _least(["a", _step("u", 5, "I"), _step("n", 10, "II"), _step("s", 10, "II")])}
    may, keep = "fault NOT IN ('blank', 'duplicate')", "fault NOT IN ('blank', 'duplicate') AND initial = "
    gone = lambda state: f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 2, 'a': {state}.a || 'D'}} END"
    rows = {
        "n": gone("n0"), "s": _least([gone("s0"), _edited("n0", "K", 0, keep + "'s'")]),
        "u": _least([gone("u0"), *(_edited(x, "K", 0, keep + "'u'") for x in ("n0", "s0", "a0")), *(_edited(x, "R", 1, may) for x in ("n0", "s0", "a0"))]),
        "a": _least([gone("a0"), _edited("u0", "K", 0, keep + "'a'"), _edited("u0", "R", 1, may)]),
    }
    empty = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR))"
    return rf"""
WITH RECURSIVE {_CRC_TABLE}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, {_crc32('k')} % 20 AS kind FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM damaged
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed
), faults AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
    CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(solid, 1) IN ('.', '!', '?') THEN 'fine' ELSE 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM numbered
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
  FROM faults GROUP BY conv_id
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS n, {empty} AS s, {empty} AS u, {empty} AS a FROM facts
  UNION ALL
  SELECT conv_id, i, {', '.join(f"{rows[x]} AS {x}" for x in 'nsua')} FROM (
    SELECT w.conv_id, f.i, {', '.join(f"{v} AS {k}" for k, v in after.items())}, f.fault, f.initial, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS late
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)
), cheapest AS (
  SELECT w.conv_id, {_least(['n', 'a', _step('u', 5, 'I'), _step('s', 10, 'II')])} AS best
  FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = f.n_rows
), letters AS (
  SELECT conv_id, k, best.a[k] AS edit, CASE WHEN best.a[k] = 'I' THEN NULL ELSE len(replace(best.a[1 : k], 'I', '')) END AS i,
    len(replace(best.a[1 : k], 'D', '')) AS place, len(replace(best.a, 'D', '')) AS total
  FROM (SELECT conv_id, best, unnest(range(1, len(best.a) + 1)) AS k FROM cheapest)
), made AS (
  SELECT l.conv_id, k, CASE WHEN edit = 'K' THEN f.role WHEN (place - total % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(f.text, '') AS line
  FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE edit <> 'D'
), texts AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS whole FROM made GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN cheapest b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


CONVERSATION_REPAIR = _conversation_repair()

SPELLING_VARIANTS = rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY doc_id, run
), hashed AS (
  SELECT run, times, {_crc32("concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run)")} AS h FROM runs, crc_table
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(times) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(times) >= 3
), shorter AS (
  SELECT word, n, word AS v FROM words UNION
  SELECT word, n, left(word, i) || substr(word, i + 2) FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM shorter x JOIN shorter y USING (v)
  WHERE x.word <> y.word AND CASE WHEN length(x.word) = length(y.word)
    THEN len(list_filter(range(1, length(x.word) + 1), lambda i: x.word[i] <> y.word[i])) = 1 ELSE v = x.word OR v = y.word END
), best AS (
  SELECT word, count(*) AS n_near, min({{'m': -other_n, 'w': other}}) AS b FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * w.n THEN b.w END AS form, CASE WHEN -b.m >= 2 * w.n THEN -b.m END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word
), chain AS (
  SELECT word, word AS root, form AS next FROM forms UNION ALL
  SELECT chain.word, chain.next, f.form FROM chain JOIN forms f ON f.word = chain.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
