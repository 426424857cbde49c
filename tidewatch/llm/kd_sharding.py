"""Sharding by a k-d tree: split at weighted medians along the widest metadata dimension until leaves reach the target.

Every split divides the bytes of a node in proportion to the leaves on its two sides. The median is found from sums
per value, then from sums per hash digit among the rows that share the median's value, so that a value which holds any
share of the table is split as well and no rows are sorted or gathered.

Defined cases: a null text has 0 bytes and the checksum of the empty text; null metadata is a value of its own, below
all others; equal rows go to any of the shards around a cut; an empty table gives no rows; columns that are not
named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, durable, numbered

DIGIT_BITS, DIGITS = 13, 4


def kd_shards(
    rows: DataFrame, weight: str, dimensions: list[str], order: list[str], shards: int | None = None,
    target: int | None = None, name: str = "shard",
) -> DataFrame:
    """Add an int column with the leaf, 0 to leaves - 1, that a row falls in.

    ``dimensions`` are the metadata columns: numbers are taken as they are, others by their rank. ``order`` tells rows
    apart where their metadata are equal. The number of leaves is ``shards``, or what leaves of ``target`` weight need.
    """
    placed = rows.select("*", *[
        F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(f"_d{i}")
        for i, c in enumerate(dimensions) if _numeric(rows, c)
    ])
    for i, c in enumerate(dimensions):
        if not _numeric(rows, c):
            # One row per distinct value meets in the window, not the table.
            ranks = rows.groupBy(c).agg(F.lit(1)).select(
                F.col(c).alias("_value"), F.dense_rank().over(Window.orderBy(F.col(c).asc_nulls_first())).cast("double").alias(f"_d{i}")
            )
            placed = placed.join(ranks, F.col(c).eqNullSafe(F.col("_value")), "left").drop("_value")
    fine = F.pmod(F.xxhash64(*order, F.lit(3)), F.lit(1 << 40)) * (1 << 12) + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 12))
    table = durable(placed.withColumns({"_weight": F.col(weight).cast("double"), "_fine": fine}))
    whole = table.agg(F.sum("_weight"), *[f(f"_d{i}") for i in range(len(dimensions)) for f in (F.min, F.max)]).first()
    if shards is None:
        shards = max(1, math.ceil((whole[0] or 0) / target))
    spans = [_span(whole[1 + 2 * i], whole[2 + 2 * i]) for i in range(len(dimensions))]

    leaves = {1: shards}  # node: how many leaves lie below it
    tree = table.withColumn("_node", F.lit(1).cast("long"))
    while any(m > 1 for m in leaves.values()):
        cuts = _cuts(tree, {n: m for n, m in leaves.items() if m > 1}, spans)
        tree = _descend(tree, cuts, len(dimensions))
        # A node without rows has no cut; its rows would be none, so its leaves stay empty.
        leaves = {n: m for n, m in leaves.items() if m == 1} | {
            2 * n + side: part for n, m in leaves.items() if m > 1 for side, part in ((0, m // 2), (1, m - m // 2))
        }
    # From left to right: nodes of different depths are compared by their paths.
    depth = max(n.bit_length() for n in leaves)
    numbers = {n: i for i, n in enumerate(sorted(leaves, key=lambda n: n << (depth - n.bit_length())))}
    to = rows.sparkSession.createDataFrame(list(numbers.items()), f"_leaf long, {name} int")
    return tree.join(F.broadcast(to), F.col("_node") == F.col("_leaf")).select(*rows.columns, name)  # one row per leaf


def _numeric(rows: DataFrame, column: str) -> bool:
    return rows.schema[column].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")


def _span(low: float | None, high: float | None) -> float:
    return high - low if low is not None and math.isfinite(low) and high > low else 1.0


def _value(cases: dict[int, int]):
    """The value of each row in its node's dimension; nodes that are not split are left out before."""
    out = None
    for d in sorted(set(cases.values())):
        here = F.col("_node").isin([n for n, c in cases.items() if c == d])
        out = F.when(here, F.col(f"_d{d}")) if out is None else out.when(here, F.col(f"_d{d}"))
    return out


def _cuts(tree: DataFrame, split: dict[int, int], spans: list[float]) -> list[tuple[int, int, float, int]]:
    """(node, dimension, value, hash): rows below go left. Everything that comes back is a few numbers per node."""
    here = tree.where(F.col("_node").isin(list(split)))
    extents = here.groupBy("_node").agg(
        F.sum("_weight").alias("w"), *[f(f"_d{i}").alias(f"{n}{i}") for i in range(len(spans)) for n, f in (("a", F.min), ("b", F.max))]
    ).collect()
    chosen, wanted = {}, {}
    for r in extents:
        n = r["_node"]
        widths = [(r[f"b{i}"] - r[f"a{i}"]) / s if r[f"b{i}"] > r[f"a{i}"] else 0.0 for i, s in enumerate(spans)]
        chosen[n] = max(range(len(spans)), key=lambda i: (widths[i], -i))
        wanted[n] = r["w"] * (split[n] // 2) / split[n]
    if not chosen:
        return []
    valued = here.where(F.col("_node").isin(list(chosen))).withColumn("_key", _value(chosen))
    at = _crossing(valued.groupBy("_node", "_key").agg(F.sum("_weight").alias("w"), F.count("*").alias("n")), wanted)
    found = {n: (key, rest) for n, key, rest, _ in at}
    low = dict.fromkeys(found, 0)  # the hash digits found so far
    open_nodes = {n for n, _, _, rows in at if rows > 1}
    for digit in range(DIGITS):
        if not open_nodes:
            break
        shift = DIGIT_BITS * (DIGITS - 1 - digit)
        prefix = [(n, float(found[n][0]), low[n]) for n in open_nodes]
        few = F.broadcast(tree.sparkSession.createDataFrame(prefix, "_n long, _at double, _low long"))  # one row per node
        tied = valued.join(few, (F.col("_node") == F.col("_n")) & (F.col("_key") == F.col("_at"))).where(
            F.shiftright("_fine", shift + DIGIT_BITS) == F.col("_low")
        )
        sums = tied.groupBy("_node", F.shiftright("_fine", shift).alias("_key")).agg(F.sum("_weight").alias("w"), F.count("*").alias("n"))
        for n, key, rest, rows in _crossing(sums, {n: found[n][1] for n in open_nodes}):
            found[n], low[n] = (found[n][0], rest), key
            if rows <= 1:
                low[n] = key << shift
                open_nodes.discard(n)
    return [(n, chosen[n], float(value), low[n]) for n, (value, _) in found.items()]


def _crossing(sums: DataFrame, wanted: dict[int, float]) -> list[tuple]:
    """Per node: the key in whose stretch the wanted weight lies, what of the weight is left for it, and its rows."""
    so_far = Window.partitionBy("_node").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    few = F.broadcast(sums.sparkSession.createDataFrame(list(wanted.items()), "_w long, _want double"))  # one row per node
    before = F.coalesce(F.sum("w").over(so_far), F.lit(0.0))
    hit = (
        sums.withColumn("_before", before).join(few, F.col("_node") == F.col("_w"))
        .where(F.col("_before") <= F.col("_want"))
        .groupBy("_node").agg(F.max_by(F.struct("_key", "_before", "_want", "n"), F.struct("_before", "_key")).alias("x"))
    )
    return [(r["_node"], r["x"]["_key"], r["x"]["_want"] - r["x"]["_before"], r["x"]["n"]) for r in hit.collect()]


def _descend(tree: DataFrame, cuts: list[tuple], dimensions: int) -> DataFrame:
    if not cuts:
        return tree
    few = F.broadcast(tree.sparkSession.createDataFrame(cuts, "_n long, _dim int, _cut double, _low long"))  # one row per node
    value = F.get(F.array(*[F.col(f"_d{i}") for i in range(dimensions)]), F.col("_dim"))
    right = (value > F.col("_cut")) | ((value == F.col("_cut")) & (F.col("_fine") >= F.col("_low")))
    node = F.when(F.col("_n").isNull(), F.col("_node")).otherwise(F.col("_node") * 2 + F.when(right, 1).otherwise(0))
    return tree.join(few, F.col("_node") == F.col("_n"), "left").withColumn("_node", node).drop("_n", "_dim", "_cut", "_low")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents with size, checksum, shard and slot; shards hold near equal bytes (law ``bytes``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("source").alias("_source"), F.col("lang").alias("_lang"),
    ).withColumn("_length", F.log2("size"))
    leaves = durable(kd_shards(rows, "size", ["_source", "_lang", "_length"], ["doc_id", "text_crc32"], shards))
    return numbered(leaves, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_kd_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(documents(spark, folder))
