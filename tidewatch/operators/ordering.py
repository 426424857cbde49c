"""Order-dependent operators that stay distributed: running totals, row index, exact quantiles.

A window without a partition key would sort the whole table in one task. Here Spark deals the rows out by ranges of the
order, each task adds up its own sorted range as a stream, and the totals of the ranges, one row per range and group,
say what comes before each. Ranges also follow a hash of the row's place, so a value that a third of all rows share is cut
like any other stretch. No sample and no cut point passes through Python or stands in a plan.

Quantiles are found by sketches and then counted exactly, see ``exact_quantiles``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import durable

#: Up to so many totals of ranges are broadcast to the rows, some MB; more are joined by a shuffle.
BROADCAST_TOTALS = 100_000
#: Size of a quantile sketch and twice its error of rank; a sketch takes some hundred kilobytes.
SKETCH_SIZE, SKETCH_MARGIN = 8192, 0.002
#: A range that is too large is cut down to a few of so many parts.
GRID = 512
#: So many rows around a wanted rank are sorted in one task; while there are more, they are sketched again.
MOST_SORTED = 1_000_000


def position_in(cuts: Sequence[float], value: Column) -> Column:
    """How many of the ascending ``cuts`` are <= value, by binary search over a literal array."""
    if not len(cuts):
        return F.lit(0)
    literal = F.lit(np.asarray(cuts, dtype="float64"))
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    found = F.aggregate(
        F.lit(np.asarray(steps, dtype="int32")),
        F.lit(0),
        lambda found, step: F.when(F.get(literal, found + step - 1) <= value, found + step).otherwise(found),
    )
    # Never null, and visibly so: a join on it then adds no null test, which would be pushed below an
    # aggregation and repeat the search, and the score in it, on every input row.
    return F.coalesce(found, F.lit(0))


def _changes(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """True for rows whose group differs from that of the row before."""
    out = np.zeros(batch.num_rows, bool)
    for c in by:
        code = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= code[1:] != code[:-1]
    return out


def _added_up(by: Sequence[str], names: Sequence[str]):
    """Replace the columns ``names`` by their running sums inside each group of a sorted stream; a null adds nothing."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carried = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = tuple(batch.column(c)[0].as_py() for c in by)
            if own != group:
                carried = dict.fromkeys(names, 0)
            starts = np.concatenate([[0], np.flatnonzero(_changes(batch, by))])
            lengths = np.diff(np.append(starts, batch.num_rows))
            out = batch
            for name in names:
                at = out.schema.get_field_index(name)
                values = out.column(at).fill_null(0).to_numpy(zero_copy_only=False)
                sums = np.cumsum(values)
                before = np.concatenate([[0], sums[starts[1:] - 1]])
                before[0] -= carried[name]
                run = sums - np.repeat(before, lengths)
                out = out.set_column(at, out.schema.field(at), pa.array(run, out.schema.field(at).type))
                carried[name] = run[-1]
            group = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in by)
            yield out

    return add


def running_totals(
    df: DataFrame,
    sums: Mapping[str, Column],
    order_by: Sequence[str],
    by: Sequence[str] = (),
    buckets: int | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums along ``order_by``, per group; nulls come first and a null is a group like any other.

    With ``totals`` each sum also gets ``<name>_total``, its total in the group. Rows that are equal in the whole order stand
    in the order of a hash of their place. ``buckets`` is the number of ranges, by default that of the session's shuffles.
    The rows are moved once and written once.
    """
    by, order_by = list(by), list(order_by)
    whole = {n: T.LongType() if df.select(c).schema[0].dataType.typeName() in ("byte", "short", "integer", "long", "boolean") else T.DoubleType()
             for n, c in sums.items()}
    keyed = df.withColumns({f"_run_{n}": c.cast(whole[n]) for n, c in sums.items()} | {"_salt": F.xxhash64(F.monotonically_increasing_id())})
    keyed = keyed.withColumns({f"_in_{n}": F.col(f"_run_{n}") for n in sums})
    order = [*[F.col(c).asc_nulls_first() for c in (*by, *order_by)], F.col("_salt")]
    ranged = keyed.repartitionByRange(*([buckets] if buckets else []), *order).sortWithinPartitions(*order).drop("_salt")
    placed = ranged.withColumn("_range", F.spark_partition_id())
    placed = durable(placed.mapInArrow(_added_up(by, [f"_run_{n}" for n in sums]), placed.schema))
    per_range = placed.groupBy(*by, "_range").agg(*[F.coalesce(F.sum(f"_in_{n}"), F.lit(0)).alias(f"_sum_{n}") for n in sums])
    # Windows over one row per range and group; a group's rows lie in neighbouring ranges, so these are at most ranges plus groups.
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    offsets = durable(per_range.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_range").alias("_by__range"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).cast(whole[n]).alias(f"_before_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(every).cast(whole[n]).alias(f"{n}_total") for n in sums if totals],
    ))
    here = F.col("_range") == F.col("_by__range")
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = placed.join(F.broadcast(offsets) if offsets.count() <= BROADCAST_TOTALS else offsets, here)
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{n}") + F.col(f"_run_{n}")).alias(n) for n in sums],
        *[F.col(f"{n}_total") for n in sums if totals],
    )


def row_index(
    df: DataFrame, order_by: Sequence[str], name: str = "row_index", buckets: int | None = None, total: bool = False
) -> DataFrame:
    """Dense 0-based index along a total order; with ``total`` also the row count as ``<name>_total``."""
    counted = running_totals(df, {name: F.lit(1).cast("long")}, order_by, buckets=buckets, totals=total)
    return counted.withColumn(name, F.col(name) - 1)


def align_by_position(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], name: str = "row_index"
) -> DataFrame:
    """Pair the i-th row of one table with the i-th of the other; the longer one is cut off."""
    return row_index(left, left_order, name).join(row_index(right, right_order, name), name)


def partition_clients(df: DataFrame, n: int, order_by: Sequence[str], name: str = "client") -> DataFrame:
    """Contiguous shares of equal size; the remainder goes to the last client."""
    placed = row_index(df, order_by, "_index", total=True)
    size = F.floor(F.col("_index_total") / n)
    share = F.when(size > 0, F.least(F.floor(F.col("_index") / size), F.lit(n - 1))).otherwise(n - 1)
    return placed.withColumn(name, share.cast("int")).drop("_index", "_index_total")


def exact_quantiles(
    df: DataFrame, column: str, fractions: Sequence[float], by: Sequence[str] = (), most: int = MOST_SORTED,
    sketch: int = SKETCH_SIZE, margin: float = SKETCH_MARGIN,
) -> dict[tuple, dict[float, float]]:
    """Exact quantiles with linear interpolation, per group: ``{group key: {fraction: value}}``.

    Mergeable sketches, added up per task and then across tasks, give a small range of values around each wanted rank. Rows below
    the range are counted and the few distinct values inside it are sorted, which gives the exact value. While a range holds
    more than ``most`` rows it is sketched again; a rank outside its range, which a sketch may get wrong, takes the open
    side instead, so the result never depends on a sketch. Only counts and bounds come back to the driver: one row per group.
    ``by`` is meant for a bounded number of groups, such as labels, detectors or clients. A NaN counts as infinite.
    """
    by = list(by)
    value = F.nanvl(F.col(column).cast("double"), F.lit(float("inf")))
    values = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], value.alias("_value")).where(F.col("_value").isNotNull())
    values = values.persist(StorageLevel.MEMORY_AND_DISK)  # a score is computed once, lost blocks again
    try:
        return _Ranks(values, len(by), list(fractions), most, sketch, margin).values()
    finally:
        values.unpersist()


class _Ranks:
    """Wanted ranks of each group, each with the range [low, high] of values that holds it and the number of rows below."""

    def __init__(self, rows: DataFrame, groups: int, fractions: list[float], most: int, sketch: int, margin: float):
        self.rows, self.by, self.fractions = rows, [f"_g{i}" for i in range(groups)], fractions
        self.most, self.sketch, self.margin = most, sketch, margin

    def values(self) -> dict[tuple, dict[float, float]]:
        ranks = F.lit(np.clip(np.array([[f - self.margin, f + self.margin] for f in self.fractions]).ravel(), 0.0, 1.0))
        sketched = self.rows.groupBy(*self.by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_value", F.lit(self.sketch)).alias("s")).where("n > 0")
        found = sketched.select(*self.by, "n", F.kll_sketch_get_quantile_double("s", ranks).alias("q")).collect()
        self.n = {tuple(r[c] for c in self.by): r["n"] for r in found}
        self.low, self.high = {}, {}
        for r in found:
            key = tuple(r[c] for c in self.by)
            small = r["n"] <= self.most
            self.low[key] = [-np.inf if small or f - self.margin <= 0 else q for f, q in zip(self.fractions, r["q"][::2])]
            self.high[key] = [np.inf if small or f + self.margin >= 1 else q for f, q in zip(self.fractions, r["q"][1::2])]
        if not self.n:
            return {}
        while True:
            below, inside = self._counts()
            again = {}
            for key, n in self.n.items():
                for t, f in enumerate(self.fractions):
                    first, last, _ = _rank_pair(f, n)
                    if first < below[key][t]:
                        self.low[key][t] = -np.inf
                        again[key, t] = None
                    if last >= below[key][t] + inside[key][t]:
                        self.high[key][t] = np.inf
                        again[key, t] = None
                    if (key, t) not in again and inside[key][t] > self.most and self.low[key][t] < self.high[key][t]:
                        again[key, t] = ((first - below[key][t]) / inside[key][t], (last + 1 - below[key][t]) / inside[key][t])
            narrower = {k: v for k, v in again.items() if v is not None}
            if narrower:
                self._narrow(narrower)
            if not again:
                return self._sorted(below)

    def _ranged(self) -> DataFrame:
        """Every row with the ranges of its group, which are one row per group."""
        schema = T.StructType([*[T.StructField(f"_r{c}", self.rows.schema[c].dataType) for c in self.by],
                               T.StructField("_low", T.ArrayType(T.DoubleType())), T.StructField("_high", T.ArrayType(T.DoubleType()))])
        ranges = [(*key, [float(x) for x in self.low[key]], [float(x) for x in self.high[key]]) for key in self.n]
        few = F.broadcast(self.rows.sparkSession.createDataFrame(ranges, schema))
        same = F.lit(True)
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"_r{c}"))
        return self.rows.join(few, same).drop(*[f"_r{c}" for c in self.by])

    def _counts(self) -> tuple[dict, dict]:
        if all(low == -np.inf and high == np.inf for key in self.n for low, high in zip(self.low[key], self.high[key])):
            return {k: [0] * len(self.fractions) for k in self.n}, {k: [n] * len(self.fractions) for k, n in self.n.items()}
        v, below, inside = F.col("_value"), {}, {}
        found = self._ranged().groupBy(*self.by).agg(
            *[F.count_if(v < F.get("_low", t)).alias(f"b{t}") for t in range(len(self.fractions))],
            *[F.count_if((v >= F.get("_low", t)) & (v <= F.get("_high", t))).alias(f"i{t}") for t in range(len(self.fractions))]).collect()
        for r in found:
            key = tuple(r[c] for c in self.by)
            below[key] = [r[f"b{t}"] for t in range(len(self.fractions))]
            inside[key] = [r[f"i{t}"] for t in range(len(self.fractions))]
        return below, inside

    def _inside(self) -> DataFrame:
        """One row for each range that a row lies in."""
        targets = F.sequence(F.lit(0), F.lit(len(self.fractions) - 1))
        mine = F.filter(targets, lambda t: (F.col("_value") >= F.get("_low", t)) & (F.col("_value") <= F.get("_high", t)))
        return self._ranged().select(*self.by, F.explode(mine).alias("_t"), "_value")

    def _narrow(self, wanted: dict) -> None:
        """Sketch the rows of ranges that are too large and take a smaller range around the wanted rank."""
        targets = sorted({t for _, t in wanted})
        sketches = self._inside().where(F.col("_t").isin(targets)).groupBy(*self.by, "_t").agg(
            F.kll_sketch_agg_double("_value", F.lit(self.sketch)).alias("s"), F.min("_value").alias("least"), F.max("_value").alias("most"))
        grid = F.lit(np.linspace(0.0, 1.0, GRID + 1))
        found = sketches.select(*self.by, "_t", "least", "most", F.kll_sketch_get_quantile_double("s", grid).alias("q")).collect()
        for r in found:
            key, t = tuple(r[c] for c in self.by), r["_t"]
            if (key, t) in wanted:
                first, last = wanted[key, t]
                at, to = int((first - self.margin) * GRID), int(np.ceil((last + self.margin) * GRID))
                self.low[key][t] = r["least"] if at <= 0 else r["q"][at]
                self.high[key][t] = r["most"] if to >= GRID else r["q"][to]

    def _sorted(self, below: dict) -> dict[tuple, dict[float, float]]:
        """The values at the wanted ranks, from the distinct values of each range and their counts."""
        counted = self._inside().groupBy(*self.by, "_t", "_value").count()
        upto = F.sum("count").over(Window.partitionBy(*self.by, "_t").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
        wanted = [
            (*key, t, place - below[key][t], place)
            for key, n in self.n.items() for t, f in enumerate(self.fractions) for place in sorted(set(_rank_pair(f, n)[:2]))
        ]
        schema = T.StructType([*[T.StructField(f"_r{c}", self.rows.schema[c].dataType) for c in self.by], T.StructField("_w", T.IntegerType()),
                               T.StructField("_rank", T.LongType()), T.StructField("_place", T.LongType())])
        few = F.broadcast(self.rows.sparkSession.createDataFrame(wanted, schema))  # two ranks per fraction and group
        same = F.col("_t") == F.col("_w")
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"_r{c}"))
        hits = counted.withColumn("_upto", upto).join(few, same).where(
            (F.col("_upto") - F.col("count") <= F.col("_rank")) & (F.col("_upto") > F.col("_rank")))
        at: dict[tuple, float] = {}
        for r in hits.select(*self.by, "_t", "_place", "_value").collect():  # one row per wanted rank
            at[tuple(r[c] for c in self.by), r["_t"], r["_place"]] = r["_value"]
        result: dict[tuple, dict[float, float]] = {}
        for key, n in self.n.items():
            for t, f in enumerate(self.fractions):
                first, last, part = _rank_pair(f, n)
                a, b = at[key, t, first], at[key, t, last]
                result.setdefault(key, {})[f] = a + (b - a) * part if b != a else a
        return result


def _rank_pair(fraction: float, n: int) -> tuple[int, int, float]:
    place = fraction * (n - 1)
    low = int(np.floor(place))
    return low, min(low + 1, n - 1), place - low


def exact_quantile(df: DataFrame, column: str, fraction: float) -> float | None:
    """One exact quantile of the whole column; None when it has no values."""
    return exact_quantiles(df, column, [fraction]).get((), {}).get(fraction)
