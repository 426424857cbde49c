"""Helpers that several of the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import durable

__all__ = ["durable", "documents", "numbered", "only", "ordered_rows", "word_count"]

#: Up to so many ids, at most 32 MB, are broadcast to pick rows; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000

#: Words `[^\x20\x09-\x0D]+` for Spark's own regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words in the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def only(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows with (left_semi) or without (left_anti) one of the ids in the column ``doc``."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", how)


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str, slice_rows: int = 20_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in a scattered but repeatable order.

    ``order`` must tell rows apart; equal rows get numbers in any order. A group is cut by hash into slices
    of about ``slice_rows`` rows, so a group may hold any share of the table: only row counts per slice meet
    in one task. ``rows`` is read three times and should be a stored table.
    """
    totals = rows.groupBy(*by).agg(F.ceil(F.count("*") / slice_rows).alias("_slices"))
    sized = rows.join(totals.withColumnsRenamed({c: f"_t_{c}" for c in by}), _matches(by), "inner").drop(*[f"_t_{c}" for c in by])
    sliced = sized.withColumn("_slice", F.pmod(F.xxhash64(*order, F.lit(7)), F.col("_slices")))
    counts = sliced.groupBy(*by, "_slice").count()
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(c).alias(f"_t_{c}") for c in by],
        F.col("_slice").alias("_t__slice"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(F.xxhash64(*order), *order)
    return (
        sliced.join(starts, _matches([*by, "_slice"]), "inner")
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .select(*rows.columns, name)
    )


def _matches(by: list[str]) -> Column:
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return condition


def ordered_rows(docs: DataFrame, name: str = "doc") -> DataFrame:
    """Add a long that tells documents apart and rises with doc_id, nulls first; documents are rows equal in id and text.

    Where ids are unique integers, it is the id itself and nothing moves. Otherwise the distinct (id, text hash) pairs
    are range-partitioned and numbered; only row counts per partition meet in one task. ``docs`` has no such column yet.
    """
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        if docs.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty():
            return docs.withColumn(name, F.col("doc_id").cast("long"))
    text_hash = F.xxhash64("text")
    order = [F.col("_id").asc_nulls_first(), F.col("_hash")]
    pairs = docs.select(F.col("doc_id").alias("_id"), text_hash.alias("_hash")).distinct()
    # monotonically_increasing_id is the partition in its upper bits and the row of the partition in its lower 33.
    placed = durable(pairs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    named = placed.withColumn("_p", part).join(starts, F.col("_p") == F.col("_part")).select(
        "_id", "_hash", (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))
    return docs.withColumn("_own", text_hash).join(
        named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash"))).select(*docs.columns, name)
