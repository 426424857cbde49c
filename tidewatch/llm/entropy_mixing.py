"""Mixing sources to target weights by entropy balancing.

Document rates of a source are tilted exponentially in the document's size, ``min(limit, exp(lambda * size / mean))``:
the rates nearest to 1 in relative entropy whose words add up to the source's target. The multipliers of all sources
are found together by safeguarded Newton steps on the convex dual, each one pass over the counts of documents per
source and size (documents of one source and size have one rate, so these counts stand for all documents however many
a source has). Rates are then rounded into copies, large sizes first, each rounding making up for those before it, so
that hardly anything is left over; a last pass exchanges single copies as long as that brings the words nearer to the target, and
where a source has too few documents for that, tries all choices for its smallest ones.
Multipliers are rounded before use, so that sums in another order give the same copies.

Defined cases: a null text or one without words has size 0, rate 0 and is not taken; a null source is a source, the
last one; repeated rows are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, durable, numbered, word_count

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2.0
STEPS, TOLERANCE, PLACES = 200, 1e-9, 9


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Per source: words to take of ``share`` times all words, by weight, at most ``limit`` times its own words.

    ``sizes`` has one row (source, source_size) per source. Sharing the excess of full sources again and again ends
    where every target is the smaller of the limit and one common multiple of the weight; the multiple follows from
    running sums along limit / weight.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = F.col("source_size") * F.lit(float(limit))
    listed = sizes.withColumn("_at", place).withColumns({
        "_weight": F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_at", F.lit(len(weights))).cast("int")), "_cap": cap,
    }).withColumn("_full_at", F.col("_cap") / F.col("_weight"))
    order = Window.orderBy("_full_at", "_at")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    # The first source, along limit / weight, that the common multiple does not fill.
    first = F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "_at", "_level"))).over(everything)
    found = listed.withColumn("_level", level).withColumn("_common", first["_level"])
    target = F.when(F.col("_common").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_common") * F.col("_weight")))
    return found.select("source", "source_size", target.alias("target"))


def _tilt(multiplier: Column, x: Column, limit: float) -> Column:
    return F.least(F.lit(float(limit)), F.exp(F.least(multiplier * x, F.lit(50.0))))


def solve_rates(counts: DataFrame, targets: DataFrame, limit: float = LIMIT, steps: int = STEPS) -> DataFrame:
    """Add the rate to (source, size, n): Newton iterations on the dual, all sources at once.

    The state is a table of one row per source (multiplier and the bracket it must lie in), stored after each step.
    """
    mean = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("_mean"))
    goal = targets.join(mean.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "target", "source_size", "_mean")
    scaled = durable(
        counts.where(F.col("size") > 0).join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select("source", "size", "n", (F.col("size") / F.col("_mean")).alias("x"))
    )
    # Sources that are to be taken whole at the limit, or have no words, need no multiplier.
    full = F.col("target") >= F.col("source_size") * F.lit(limit * (1 - 1e-12))
    state = durable(goal.where(~full & (F.col("source_size") > 0)).select(
        "source", "target", F.lit(0.0).alias("m"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done")))
    for step in range(steps + 1):
        if step == steps:
            raise RuntimeError(f"rates have not settled after {steps} steps")
        s = state.select(F.col("source").alias("_s"), "m")
        rate = _tilt(F.col("m"), F.col("x"), limit)
        words = F.col("size") * F.col("n")
        sums = scaled.join(s.hint("merge"), F.col("source").eqNullSafe(F.col("_s"))).groupBy("source").agg(
            F.sum(rate * words).alias("value"),
            F.sum(F.when(rate < limit, rate * F.col("x") * words).otherwise(0.0)).alias("slope"),
        ).withColumnRenamed("source", "_g")
        gap = F.col("value") - F.col("target")
        low, high = F.when(gap < 0, F.col("m")).otherwise(F.col("low")), F.when(gap > 0, F.col("m")).otherwise(F.col("high"))
        newton = F.col("m") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.when(F.col("slope") > 0, gap / F.col("slope"))
                                         .otherwise(F.signum(gap) * 2.0)))
        inside = (newton > F.col("low2")) & (newton < F.col("high2"))
        near = F.abs(gap) <= F.col("target") * TOLERANCE
        state = durable(
            state.join(sums.hint("merge"), F.col("source").eqNullSafe(F.col("_g")))
            .withColumns({"low2": low, "high2": high, "near": near | (F.col("high2") - F.col("low2") < 1e-13)})
            .select("source", "target", F.when(F.col("near"), F.col("m")).when(inside, newton)
                    .otherwise((F.col("low2") + F.col("high2")) / 2).alias("m"), F.col("low2").alias("low"), F.col("high2").alias("high"),
                    F.col("near").alias("done"))
        )
        if state.where(~F.col("done")).isEmpty():
            break
    solved = state.select(F.col("source").alias("_s"), F.round("m", PLACES).alias("m"))
    return scaled.join(solved.hint("merge"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "size", "n", F.coalesce(_tilt(F.col("m"), F.col("x"), limit), F.lit(float(limit))).alias("rate"))


def _rounded(group: pd.DataFrame) -> pd.DataFrame:
    """Copies per size of one source, large sizes first; the words still owed go with the next size.

    A size is never taken so often that the target is passed, nor so seldom that the smaller sizes together could not make
    up for it; where both cannot be had, the nearer miss is taken. What is then left over is made smaller by single copies.
    """
    group = group.sort_values("size", ascending=False)
    size, n, rate, limit = (group[c].tolist() for c in ("size", "n", "rate", "_limit"))
    target = group["_target"].iloc[0]
    below = [0] * (len(size) + 1)  # words that the smaller sizes can give at most
    for i in reversed(range(len(size))):
        below[i] = below[i + 1] + size[i] * int(n[i] * limit[i])
    copies, owed, left = [], 0.0, float(target)
    for i, (s, k) in enumerate(zip(size, n)):
        owed += s * k * rate[i]
        most = int(k * limit[i])
        high = math.floor(left / s + 1e-9)
        low = math.ceil((left - below[i + 1]) / s - 1e-9)
        if low > high:  # neither fits: what would be missing, or what would be too much
            m = high if left - high * s - below[i + 1] <= low * s - left else low
        else:
            m = min(max(round(owed / s), low), high)
        m = min(max(m, 0), most)
        copies.append(m)
        owed -= m * s
        left -= m * s
    return group.assign(copies=_repaired(np.array(size, "int64"), np.array(n) * np.array(limit), np.array(copies, "int64"), left))[["source", "size", "n", "copies"]]


def _repaired(size: np.ndarray, most: np.ndarray, copies: np.ndarray, left: float) -> np.ndarray:
    """Bring what is left over nearer to nothing: one copy more of a size, one less of another, or both, as long as that helps."""
    while abs(left) > 0.5:
        more, less = np.flatnonzero(copies < np.floor(most)), np.flatnonzero(copies > 0)
        more, less = more[np.argsort(size[more], kind="stable")], less[np.argsort(size[less], kind="stable")]
        gains = np.concatenate([[0], size[more]])  # a change of nothing goes with either
        wanted = np.concatenate([[0], size[less]])
        at = np.searchsorted(gains, wanted + left)
        best = (abs(left), 0, 0)
        for near in (np.clip(at - 1, 0, len(gains) - 1), np.clip(at, 0, len(gains) - 1)):
            rest = np.abs(left - (gains[near] - wanted))
            k = int(rest.argmin())
            best = min(best, (float(rest[k]), int(near[k]), k))
        rest, up, down = best
        if rest >= abs(left) - 1e-9:
            break
        if up:
            copies[more[up - 1]] += 1
        if down:
            copies[less[down - 1]] -= 1
        left -= int(gains[up] - wanted[down])
    return _searched(size, most, copies, left) if abs(left) > 0.5 else copies


SEARCHED_SIZES = 11  # 3 ** 11 choices


def _searched(size: np.ndarray, most: np.ndarray, copies: np.ndarray, left: float) -> np.ndarray:
    """Try every choice of none, one or two copies, or one more or less of common sizes, for the smallest sizes together.

    Where a source has so few documents that no exchange of two helps, this finds what can be had.
    """
    some = np.argsort(size, kind="stable")[:SEARCHED_SIZES]
    least, sums = np.zeros(len(some), "int64"), np.zeros(1, "int64")
    for k, i in enumerate(some.tolist()):
        least[k] = 0 if most[i] <= 2 else min(max(copies[i] - 1, 0), int(most[i]) - 2)
        steps = min(2, int(most[i]) - least[k]) + 1
        sums = (sums[:, None] + size[i] * np.arange(3)[None, :]).ravel() if steps == 3 else np.where(
            np.arange(3)[None, :] < steps, sums[:, None] + size[i] * np.arange(3)[None, :], np.iinfo("int64").max // 4).ravel()
    free = left + float((size[some] * (copies[some] - least)).sum())
    at = int(np.abs(free - sums).argmin())
    if abs(free - sums[at]) < abs(left) - 1e-9:
        for k in reversed(range(len(some))):
            at, taken = divmod(at, 3)
            copies[some[k]] = least[k] + taken
    return copies


def mixed_copies(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(doc_id, _text_hash, size, source, source_size, target, copies) for every row of ``docs``."""
    rows = durable(docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), "source", word_count(F.col("text")).alias("size")))
    counts = durable(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = durable(source_targets(sizes, weights, share, limit))
    rates = solve_rates(counts, targets, limit)
    # One row per size meets in a source's group: k different sizes need k * k / 2 words, so there are few.
    goal = targets.select(F.col("source").alias("_g"), F.col("target").alias("_target"))
    rates = rates.join(goal.hint("merge"), F.col("source").eqNullSafe(F.col("_g"))).drop("_g")
    plan = durable(rates.withColumn("_limit", F.lit(float(limit))).groupBy("source").applyInPandas(
        _rounded, f"source {rows.schema['source'].dataType.simpleString()}, size long, n long, copies long"))
    plan = plan.select(
        F.col("source").alias("_ps"), F.col("size").alias("_psize"), F.floor(F.col("copies") / F.col("n")).alias("_base"),
        F.pmod("copies", F.col("n")).alias("_more"),
    )
    ranked = numbered(rows, ["source", "size"], [F.col("doc_id"), F.col("_text_hash")], "_rank")
    chosen = ranked.join(plan, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("size") == F.col("_psize")), "left")
    copies = F.coalesce(F.col("_base") + F.when(F.col("_rank") < F.col("_more"), 1).otherwise(0), F.lit(0)).cast("long")
    goals = targets.withColumnRenamed("source", "_ts")
    return chosen.withColumn("copies", copies).join(goals, F.col("source").eqNullSafe(F.col("_ts"))).select(
        "doc_id", "_text_hash", "size", "source", "source_size", "target", "copies")


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Rows that repeat both id and text are one document here: their copies are added up and then written once each.
    """
    plan = mixed_copies(docs, weights, share, limit).groupBy(F.col("doc_id").alias("_pd"), F.col("_text_hash").alias("_ph"), F.col("source").alias("_ps")).agg(
        F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
    # Of equal rows, which cannot be told apart, each carries its part of the sum; the first parts are the larger ones.
    text_hash = F.xxhash64("text")
    joined = docs.join(plan, docs["doc_id"].eqNullSafe(F.col("_pd")) & (text_hash == F.col("_ph")) & docs["source"].eqNullSafe(F.col("_ps")))
    nth = F.row_number().over(Window.partitionBy("_pd", "_ph", "_ps").orderBy(F.lit(1)))
    single = joined.where(F.col("_rows") == 1).withColumn("_n", F.col("_sum"))
    several = joined.where(F.col("_rows") > 1).withColumn("_n", F.floor((F.col("_sum") + F.col("_rows") - nth) / F.col("_rows")))
    every = single.unionByName(several).where(F.col("_n") > 0)
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*[every[c] for c in docs.columns])


def op4_entropy_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_copies(documents(spark, folder)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
