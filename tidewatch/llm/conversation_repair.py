"""Conversation structure repair by a grammar-compressed dynamic program.

A conversation's rows, by turn, become a sequence of codes (role initial and fault, see ``conversation_grammar``). Sequences
are cut into fragments of at most ``FRAGMENT_ROWS`` rows, and equal fragments are counted once. Re-Pair rounds replace the
most frequent pairs of symbols over all fragments by rules; every rule has one min-plus matrix and an audit rope, shared by
all conversations. A fragment's matrix is the product of its few remaining symbols. Conversations of one fragment are
done then; of longer ones, the small matrices of their fragments are put in order and joined, and each fragment then reads
its own part of the audit. A conversation may hold any share of the rows: it is sorted by range, not by a group of its own.
Only the SHA-256 of the repaired text is bound to one stream: the rows of a conversation pass through one task in order,
and of each only its text is held.

Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2 (must be for blank and duplicate rows), Insert of an empty user or
assistant row 5; a truncated row that is not deleted costs 5 more. Role initials must be ``(s?(ua)+)?`` afterwards.

Defined cases: null ids are one conversation; a null role or text is one space; null turns come first; rows that share a turn stand
in the order of role, the first 32 characters of the text and a hash of both; an empty role or one with
another initial must be reroled or deleted; a row's fault is the first of blank, duplicate, truncated; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, documents, durable
from .conversation_grammar import (
    ASSISTANT, BLANK, CODES, DUPLICATE, FINE, OTHER_ROLE, ROLES, STATES, TRUNCATED, Evaluated, Grammar, compose, ending, expected, follows,
)

FRAGMENT_ROWS = 4096  # a power of two
#: Rounds of rules, and rules a round: the grammar is broadcast and has at most ROUNDS * RULES_A_ROUND rules of some hundred bytes.
ROUNDS, RULES_A_ROUND = 12, 128
WHITE = " \t\n\x0b\x0c\r"
NAMES = {1: "user", 2: "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): faults made by the crc32 of ``conv_id:turn``; a dropped row has neither role nor text."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("_kind"))
    made = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    dropped = F.col("_kind") == 0
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(
        "conv_id", "turn", F.when(~dropped, F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(~dropped, made).alias("text"), dropped.alias("dropped"), copies.alias("_copy")).drop("_copy")


def _present(rows: DataFrame) -> DataFrame:
    """Rows with nulls as one space and the columns that put the rows of a turn in order."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return plain.withColumns({
        "_role": F.left("role", F.lit(32)), "_begin": F.left("text", F.lit(32)), "_hash": F.xxhash64("role", "text"),
    })


ORDER = ["_role", "_begin", "_hash"]


def _codes(present: DataFrame) -> DataFrame:
    """(conv_id, turn, at, code, hashes): ``at`` rises with conversation, turn and order; duplicates are not known yet."""
    role, rest = F.left("role", F.lit(1)), F.rtrim("text", F.lit(WHITE))
    initial = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(OTHER_ROLE)
    fault = F.when(rest == "", BLANK).when(F.right(rest, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    # Rows that are equal in all are told apart by their place in the input, so that no range is larger than the others.
    keys = present.select(
        "conv_id", "turn", *ORDER, F.xxhash64(F.lit(1), "text", "role").alias("_second"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt"),
        (initial * 4 + fault).cast("int").alias("code"))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), *map(F.col, ORDER), F.col("_salt")]
    placed = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    return durable(placed.select("conv_id", "turn", "code", "_hash", "_second", F.monotonically_increasing_id().alias("at")))


def _fragment_rows(entries: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Codes and turns of one fragment from its sorted entries (at, first, code, turn)."""
    values = entries.column("entries")[i].values
    at, first = (np.asarray(values.field(k)) for k in (0, 1))
    row = first == 0
    known = np.zeros(len(at), bool)
    known[:-1] = (at[1:] == at[:-1]) & (first[1:] == 1)
    code = np.asarray(values.field(2).fill_null(0))[row].astype(np.int64)
    later = ~known[row] & (code % 4 != BLANK)
    code[later] = code[later] // 4 * 4 + DUPLICATE
    return code, at[row], [t for t, r in zip(values.field(3).to_pylist(), row.tolist()) if r and t is not None]


def _illegal(roles: np.ndarray) -> np.ndarray:
    a, b = roles[:-1], roles[1:]
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


FACTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, least bigint, most bigint, first_role int, last_role int"


def _fragments(codes: DataFrame) -> DataFrame:
    """(conv_id, piece, codes, facts): rows of one conversation in order, cut where the sorted table has its blocks."""
    firsts = codes.groupBy("conv_id", "_hash", "_second").agg(F.min("at").alias("at"))
    empty = {"code": F.lit(None).cast("int"), "turn": F.lit(None).cast("bigint")}
    entries = codes.select("conv_id", "at", F.lit(0).alias("first"), "code", F.col("turn").cast("bigint").alias("turn")).unionByName(
        firsts.select("conv_id", "at", F.lit(1).alias("first"), *[c.alias(n) for n, c in empty.items()]))
    grouped = entries.groupBy("conv_id", F.shiftright("at", FRAGMENT_ROWS.bit_length() - 1).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("at", "first", "code", "turn"))).alias("entries"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                code, _, turns = _fragment_rows(batch, i)
                fault, role = code % 4, code // 4
                out.append({
                    "codes": code.astype(np.uint8).tobytes(), "blank": int((fault == BLANK).sum()), "duplicate": int((fault == DUPLICATE).sum()),
                    "truncated": int((fault == TRUNCATED).sum()), "illegal": int(_illegal(role).sum()), "turns": len(set(turns)),
                    "least": turns[0] if turns else None, "most": turns[-1] if turns else None, "first_role": int(role[0]), "last_role": int(role[-1])})
            facts = pa.RecordBatch.from_pylist(out, schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), *facts.columns], ["conv_id", "piece", *schema.names])

    schema = pa.schema([("codes", pa.binary()), *((x.split()[0], pa.int32() if x.endswith("int") and not x.endswith("bigint") else pa.int64()) for x in FACTS.split(", "))])
    kind = codes.schema["conv_id"].dataType.simpleString()
    return durable(grouped.mapInArrow(cut, f"conv_id {kind}, piece bigint, codes binary, {FACTS}"))


def _sequences(column: pa.Array, width: type) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows of a binary column, and where those of each begin."""
    rows = [np.frombuffer(x.as_buffer(), width) for x in column]
    return np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)


def learn(shapes: DataFrame, rounds: int = ROUNDS, rules: int = RULES_A_ROUND) -> Grammar:
    """Re-Pair over (codes, n): in each round the most frequent pairs, each sequence counted n times, become rules."""
    grammar = Grammar()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _sequences(batch.column("symbols"), np.int32)
            weight = np.repeat(np.asarray(batch.column("n")), np.diff(offsets))
            if len(flat) < 2:
                continue
            pair = (flat[:-1] << 32) | flat[1:]
            inside = np.ones(len(pair), bool)
            inner = offsets[1:-1]
            inside[inner[(inner > 0) & (inner < len(flat))] - 1] = False
            pairs, which = np.unique(pair[inside], return_inverse=True)
            sums = np.bincount(which, weight[:-1][inside], len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], ["pair", "n"])

    def replacer(learned: Grammar):
        def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, offsets = learned.compress(*_sequences(batch.column("symbols"), np.int32), first_round=len(learned.rounds) - 1)
                parts = [flat[a:b].astype(np.int32).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), batch.column("n")], ["symbols", "n"])

        return replace

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.uint8).astype(np.int32).tobytes() for x in batch.column("codes")]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), batch.column("n")], ["symbols", "n"])

    state = durable(shapes.mapInArrow(widen, "symbols binary, n bigint"))
    for _ in range(rounds):
        found = state.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        top = [r["pair"] for r in found.orderBy(F.desc("n"), "pair").limit(rules).collect()]
        if not top:
            break
        grammar.add([(p >> 32, p & 0xFFFFFFFF) for p in top])
        state = durable(state.mapInArrow(replacer(grammar), "symbols binary, n bigint"))
    return grammar


def _unique(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices)


def _paths(pieces: DataFrame, held) -> DataFrame:
    """Of conversations of several fragments: (conv_id, piece, from, to, inserts, cost). Rows of 34 numbers stand for the fragments."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, which = _unique(batch.column("codes"))
            done = Evaluated(held.value, *_sequences(shapes, np.uint8))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("piece"), *[pa.array(list(x[which].reshape(len(which), -1)), pa.list_(pa.int64())) for x in (done.cost, done.rank)]],
                ["conv_id", "piece", "cost", "rank"])

    def join(group):
        group = group.sort_values("piece")
        cost, rank = (np.stack(group[c].tolist()).reshape(-1, STATES, STATES) for c in ("cost", "rank"))
        c, r, middles = cost[:1], rank[:1], []
        for k in range(1, len(cost)):
            c, r, middle = compose(c, r, cost[k : k + 1], rank[k : k + 1])
            middles.append(middle[0, 0])
        total, last, inserts = ending(c[0, 0], r[0, 0])
        states = [last]
        for middle in reversed(middles):
            states.append(int(middle[states[-1]]))
        states = [*reversed(states)]
        out = group[["conv_id", "piece"]].reset_index(drop=True)
        out["_from"], out["_to"], out["inserts"], out["cost"] = [0, *states[:-1]], states, [0] * (len(states) - 1) + [inserts], [0] * (len(states) - 1) + [total]
        return out

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.select("conv_id", "piece", "codes").mapInArrow(matrices, f"conv_id {kind}, piece bigint, cost array<bigint>, rank array<bigint>").groupBy("conv_id").applyInPandas(
        join, f"conv_id {kind}, piece bigint, _from int, _to int, inserts int, cost bigint")


def _audits(pieces: DataFrame) -> DataFrame:
    """(conv_id, piece, audit, cost, facts): the audit of each fragment; a conversation's cost stands at its last one."""
    shapes = durable(pieces.groupBy("codes").agg(F.count("*").alias("n")))
    held = pieces.sparkSession.sparkContext.broadcast(learn(shapes))
    several = durable(pieces.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("_c")))
    ids = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    long, short = pieces.join(ids, same, "left_semi"), pieces.join(ids, same, "left_anti")
    paths = _paths(long, held).withColumnsRenamed({"conv_id": "_pc", "piece": "_pp"})
    routed = long.join(paths, F.col("conv_id").eqNullSafe(F.col("_pc")) & (F.col("piece") == F.col("_pp"))).drop("_pc", "_pp")
    whole = short.withColumns({"_from": F.lit(None).cast("int"), "_to": F.lit(None).cast("int"), "inserts": F.lit(0), "cost": F.lit(0).cast("bigint")})
    names = [x.split()[0] for x in FACTS.split(", ")]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, which = _unique(batch.column("codes"))
            done = Evaluated(held.value, *_sequences(shapes, np.uint8))
            spelled, audits, costs = {}, [], []
            for row, a, b, inserts, cost in zip(which.tolist(), *(batch.column(c).to_pylist() for c in ("_from", "_to", "inserts", "cost"))):
                key = (row, a, b, inserts)
                if key not in spelled:
                    if a is None:
                        total, last, more = ending(done.cost[row, 0], done.rank[row, 0])
                        spelled[key] = done.letters(row, 0, last) + "I" * more, total
                    else:
                        spelled[key] = done.letters(row, a, b) + "I" * inserts, cost
                audits.append(spelled[key][0])
                costs.append(spelled[key][1] if a is None else cost)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("piece"), pa.array(audits, pa.string()), pa.array(costs, pa.int64()), *[batch.column(c) for c in names]],
                ["conv_id", "piece", "audit", "cost", *names])

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return durable(whole.unionByName(routed).mapInArrow(spell, f"conv_id {kind}, piece bigint, audit string, cost bigint, {FACTS}"))


class _Conversation:
    """What is known of one conversation while its rows pass by."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.audit, self.place, self.state = conv_id, [], 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.cost = 0
        self.least = self.most = self.last_role = None

    def add_piece(self, r: dict) -> None:
        self.audit.append(r["audit"])
        for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
            setattr(self, name, getattr(self, name) + r[name])
        if self.last_role is not None:
            self.illegal += int(_illegal(np.array([self.last_role, r["first_role"]]))[0])
        self.last_role = r["last_role"]
        if r["least"] is not None:
            self.turns += r["turns"] - (self.most is not None and self.most == r["least"])
            self.least = r["least"] if self.least is None else self.least
            self.most = r["most"]

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.place < len(self.audit) and self.audit[self.place] == "I":
            self.place += 1
            role = expected(self.state)
            self.state = follows(self.state, role)
            yield "I", NAMES[role], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands in the repaired conversation up to and with this row."""
        if isinstance(self.audit, list):
            self.audit = "".join(self.audit)
        yield from self._inserted()
        edit = self.audit[self.place]
        self.place += 1
        if edit == "D":
            return
        initial = ROLES.find(role[:1]) if edit == "K" else expected(self.state)
        self.state = follows(self.state, initial)
        yield edit, role if edit == "K" else NAMES[initial], text

    def end(self) -> Iterator[tuple[str, str, str]]:
        if isinstance(self.audit, list):
            self.audit = "".join(self.audit)
        yield from self._inserted()

    def gaps(self) -> int:
        return 0 if self.most is None else self.most - self.least + 1 - self.turns


def _streamed(rows: DataFrame, also: DataFrame | None) -> DataFrame:
    """Per conversation: first its audit pieces, then its rows in order; ``also`` names conversations that may have no rows."""
    present = _present(rows)
    audits = _audits(_fragments(_codes(present)))
    names = [x.split()[0] for x in FACTS.split(", ")]
    facts = audits.select("conv_id", F.struct("audit", "cost", *names).alias("facts"), "piece")
    texts = present.select("conv_id", "turn", "role", "text", *ORDER)
    every = facts.withColumn("_kind", F.lit(0)).unionByName(texts.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    if also is not None:
        every = every.unionByName(also.select("conv_id").withColumn("_kind", F.lit(2)), allowMissingColumns=True)
    order: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("_kind"), F.col("piece"), F.col("turn").asc_nulls_first(), *map(F.col, ORDER)]
    return every.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "_kind", "facts", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, Iterator]]:
    """Walk the sorted stream: (conversation, rows) with rows that must be read before the next step."""
    known = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "_kind", "facts", "role", "text")]
        for conv_id, kind, facts, role, text in zip(*columns):
            if known is None or known.conv_id != conv_id:
                if known is not None:
                    yield known, known.end(), True
                known = _Conversation(conv_id)
            if kind == 0:
                known.add_piece(facts)
            elif kind == 1:
                yield known, known.row(role, text), False
    if known is not None:
        yield known, known.end(), True


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, row by row."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, size = [], 0, 0
        for known, made, ended in _conversations(batches):
            for edit, role, text in made:
                out.append((known.conv_id, place, edit, role, text))
                place, size = place + 1, size + len(text)
            place = 0 if ended else place
            if size > 4_000_000 or len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names, types = ["conv_id", "place", "edit", "role", "text"], [None, pa.int64(), pa.string(), pa.string(), pa.string()]
    kind = rows.schema["conv_id"].dataType.simpleString()
    types[0] = _arrow_type(rows)
    return _streamed(rows, None).mapInArrow(repair, f"conv_id {kind}, place bigint, edit string, role string, text string")


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_report(rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, started = [], hashlib.sha256(), False
        for known, made, ended in _conversations(batches):
            for _, role, text in made:
                digest.update(f"{chr(10) if started else ''}{role}:".encode())
                digest.update(text.encode())
                started = True
            if ended:
                out.append((known.conv_id, known.gaps(), *[getattr(known, c) for c in REPORT[1:]], known.audit, digest.hexdigest()))
                digest, started = hashlib.sha256(), False
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names, types = ["conv_id", *REPORT, "audit", "repaired_sha256"], [_arrow_type(rows), *[pa.int64()] * len(REPORT), pa.string(), pa.string()]
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _streamed(rows, also).mapInArrow(report, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in REPORT)}, audit string, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = damaged(documents(spark, folder, "conversations"))
    return repair_report(rows.where(~F.col("dropped")), rows.where("dropped"))
