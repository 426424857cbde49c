"""Federated averaging: clients share parameters and counts, never rows.

A round is one pass: every client trains its own copy of the network on its own rows, on mini-batches and for several
epochs, and the copies are averaged by examples inside Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.detectors import network as nn
from tidewatch.operators.evaluate import evaluate
from tidewatch.operators.features import only_normal
from tidewatch.operators.ordering import exact_quantiles
from tidewatch.schemas import FIT_PERCENTILE, ROUND_SCHEMA
from tidewatch.session import durable


def fedavg(params: DataFrame) -> DataFrame:
    """Mean of parameter arrays weighted by examples: (client, n_examples, layer, values) -> (layer, values).

    Summed per position, so no client's or layer's arrays meet in one row before they are averaged.
    """
    weighted = F.sum(F.col("n_examples") * F.col("value")) / F.sum("n_examples")
    return (
        params.select("layer", "n_examples", F.posexplode("values").alias("pos", "value"))
        .groupBy("layer", "pos").agg(weighted.alias("value"))
        .groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))
        .select("layer", F.transform("cells", lambda c: c["value"]).alias("values"))
    )


def round_metrics(results: DataFrame) -> DataFrame:
    """Per round, from one row per client: the plain mean loss, and means weighted by examples."""
    def weighted(c: str):
        return (F.sum(F.col(c) * F.col("n_examples")) / F.sum("n_examples")).alias(f"weighted_{c}")

    return results.groupBy("round").agg(
        F.count("*").alias("n_clients"),
        F.avg("loss").alias("avg_loss"),
        F.sum("n_examples").cast("long").alias("total_examples"),
        weighted("loss"), weighted("roc_auc"), weighted("f1"),
    )


def federated_status(history: DataFrame, total_rounds: int = 5) -> DataFrame:
    """One row: current round and a node list from the last round; an empty history gives round 0, no nodes."""
    last = F.max_by(F.struct("round", "n_clients", "avg_loss", "total_examples"), F.col("round")).alias("last")
    clients = F.coalesce(F.col("last.n_clients"), F.lit(0)).cast("int")
    share = F.floor(F.col("last.total_examples") / F.greatest(clients, F.lit(1)))
    ids = F.when(clients > 0, F.sequence(F.lit(0), clients - 1)).otherwise(F.array().cast("array<int>"))
    nodes = F.transform(ids, lambda i: F.struct(
        i.alias("node_id"), F.col("last.round").alias("last_round"),
        F.col("last.avg_loss").alias("last_loss"), share.alias("n_samples"),
    ))
    return history.agg(last).select(
        F.coalesce(F.col("last.round"), F.lit(0)).alias("current_round"),
        F.lit(total_rounds).alias("total_rounds"),
        nodes.alias("nodes"),
    )


#: A client with more rows trains several replicas of about so many rows each.
ROWS_PER_REPLICA = 100_000
#: Up to so many clients, a few MB of means and deviations, are broadcast to scale rows; more are joined by a shuffle.
BROADCAST_CLIENTS = 10_000
#: Thresholds per client become a literal of the plan; more clients are refused.
MOST_EVALUATED = 10_000


def _value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_CLIENTS else df


@dataclass
class FederatedModel:
    """Shared parameters, and a table (client, n, mean, std) of what each client's rows are scaled by."""

    features: list[str]
    dims: list[int]
    params: np.ndarray
    scalers: DataFrame
    history: list[tuple] = field(default_factory=list)
    results: list[DataFrame] = field(default_factory=list)

    def history_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, ROUND_SCHEMA)

    def client_results(self) -> DataFrame:
        """(round, client, n_examples, loss) of every client's local training."""
        out = self.results[0]
        for more in self.results[1:]:
            out = out.unionByName(more)
        return out

    def score(self, df: DataFrame, client: str = "client", name: str = "score") -> DataFrame:
        """Reconstruction error under the shared parameters and the scaling of each row's client.

        A client without normals has no scaling of its own and gets the mean of the others'.
        """
        spark, d = df.sparkSession, len(self.features)
        found = self.scalers.agg(F.count("*").alias("n"), *[
            F.avg(F.get(kind, i)).alias(f"{kind}{i}") for kind in ("mean", "std") for i in range(d)]).first()  # one row
        others = {kind: [found[f"{kind}{i}"] for i in range(d)] for kind in ("mean", "std")}
        named = self.scalers.select(F.col("client").alias("_owner"), F.col("mean").alias("_mean"), F.col("std").alias("_std"))
        joined = df.join(_small(named, found["n"]), F.col(client).cast("int") == F.col("_owner"), "left")
        z = [
            ((_value(c) - F.coalesce(F.get("_mean", i), F.lit(others["mean"][i]))) / F.coalesce(F.get("_std", i), F.lit(others["std"][i]))).alias(c)
            for i, c in enumerate(self.features)
        ]
        shared = spark.sparkContext.broadcast((self.params, self.dims))

        @F.pandas_udf("double")
        def reconstruct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            layers = nn.unpack(*shared.value)
            for batch in batches:
                yield pd.Series(nn.errors(batch.to_numpy(dtype="float64"), layers))

        return joined.withColumn(name, reconstruct(F.struct(*z))).drop("_owner", "_mean", "_std")


def client_scalers(df: DataFrame, features: Sequence[str], client: str, scaler: str = "local") -> DataFrame:
    """(client, n, mean, std) per client, or the same pooled mean and deviation for all (``shared``): only moments leave a client."""
    def moments(rows: DataFrame, *by: Column) -> DataFrame:
        return rows.groupBy(*by).agg(
            F.count("*").alias("n"), F.array(*[F.avg(_value(c)) for c in features]).alias("mean"),
            F.array(*[F.when(F.stddev_pop(_value(c)) > 0, F.stddev_pop(_value(c))).otherwise(1.0) for c in features]).alias("std"))

    own = moments(df, F.col(client).cast("int").alias("client"))
    if scaler == "shared":
        pooled = moments(df).select(F.col("mean"), F.col("std"))  # one row
        return own.select("client", "n").join(F.broadcast(pooled))
    if scaler != "local":
        raise ValueError(f"unknown scaler: {scaler}")
    return own


class ClientTraining:
    """Rows of all clients, dealt to replicas: (client, part) with at most about ``ROWS_PER_REPLICA`` rows each.

    A replica's mean and deviation rows come first in the same sorted stream as its data rows, so scaling needs no join of
    rows, and neither models nor scalers of clients pass through the driver.
    """

    def __init__(self, rows: DataFrame, scalers: DataFrame, features: Sequence[str], client: str, rows_per_replica: int = ROWS_PER_REPLICA):
        self.features, self.limit = list(features), rows_per_replica
        spark = rows.sparkSession
        self.tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        parts = F.ceil(F.col("n") / rows_per_replica).cast("int")
        large = durable(scalers.where(F.col("n") > rows_per_replica).select(F.col("client").alias("_large"), parts.alias("_parts")))
        values = [_value(c).alias(f"x{i}") for i, c in enumerate(features)]
        plain = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
        data = rows.select(F.col(client).cast("int").alias("client"), *values, F.xxhash64(*plain).alias("_h"))
        data = data.join(_small(large, large.count()), F.col("client") == F.col("_large"), "left")
        data = data.withColumn("part", F.pmod("_h", F.coalesce("_parts", F.lit(1))).cast("int")).withColumn("kind", F.lit(2))
        each = scalers.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        heads = [
            each.select("client", "part", F.lit(kind).alias("kind"), *[F.get(source, i).alias(f"x{i}") for i in range(len(features))], F.lit(0).cast("long").alias("_h"))
            for kind, source in ((0, "mean"), (1, "std"))
        ]
        names = ["client", "part", "kind", *[f"x{i}" for i in range(len(features))], "_h"]
        every = heads[0].select(names).unionByName(heads[1].select(names)).unionByName(data.select(names))
        # parts of a client follow each other over the tasks; a hash of both would give some tasks several and others none
        task = F.pmod(F.pmod(F.xxhash64("client"), F.lit(self.tasks)) + F.col("part"), F.lit(self.tasks)).cast("int")
        self.rows = every.repartitionById(self.tasks, task).sortWithinPartitions("client", "part", "kind", "_h").drop("_h").persist(
            StorageLevel.MEMORY_AND_DISK)

    def run(self, params: np.ndarray, dims: Sequence[int], epochs: int, rate: float, batch: int, seed: int, number: int) -> tuple[np.ndarray, DataFrame]:
        """One round: the mean of all local models by examples, and (client, n_examples, loss) of every client.

        Every replica trains ``epochs`` epochs from the shared parameters. Models are summed inside the tasks; a client's
        replicas weigh in by their rows, so that the sum is the one of its averaged models.
        """
        held = self.rows.sparkSession.sparkContext.broadcast(params)
        columns, limit = [f"x{i}" for i in range(len(self.features))], 2 * self.limit

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, sums, out = TaskContext.get().partitionId(), np.zeros(1 + len(held.value)), []
            owner, scale, parts, size = None, [], [], 0

            def finish() -> None:
                nonlocal parts, size
                if not size:
                    return
                x, own = np.concatenate(parts), nn.Weights(held.value.copy())
                order = np.random.default_rng([seed, number, owner[1]])
                for _ in range(epochs):
                    nn.train_batches(x, own, dims, rate, batch, order)
                out.append((owner[0], len(x), float(nn.errors(x, nn.unpack(own.params, dims)).sum())))
                np.add(sums, np.concatenate([[len(x)], len(x) * own.params]), out=sums)
                parts, size = [], 0

            for b in batches:
                x = nn.matrix(b, columns)
                client, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("client", "part"))
                kind = b.column("kind").to_numpy(zero_copy_only=False)
                new = np.flatnonzero((client[1:] != client[:-1]) | (part[1:] != part[:-1])) + 1
                for first, last in zip([0, *new.tolist()], [*new.tolist(), len(x)]):
                    key = (int(client[first]), int(part[first]))
                    if key != owner:
                        finish()
                        owner, scale = key, []
                    rows = x[first:last]
                    heads = rows[kind[first:last] < 2]
                    scale.extend(heads)
                    rows = rows[len(heads):]
                    if len(rows):
                        parts.append((rows - scale[0]) / scale[1])
                        size += len(rows)
                    if size > limit:  # rows that are equal in all fields share a part; a long run of them is cut here
                        finish()
                if len(out) > 10_000:
                    yield results(out)
                    out = []
            finish()
            yield results(out)
            yield pa.RecordBatch.from_pylist([{"place": place, "sums": sums.tobytes()}], schema=schema)

        def results(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"client": c, "n": n, "loss": loss} for c, n, loss in out], schema=schema)

        schema = pa.schema([("client", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("place", pa.int32()), ("sums", pa.binary())])
        made = durable(self.rows.mapInArrow(train, "client int, n bigint, loss double, place int, sums binary"))
        held.destroy()
        sums = nn.added(made.where("place is not null").select("place", "sums"), self.tasks)
        if not sums[0]:
            raise ValueError("no rows to train on")
        clients = made.where("place is null").groupBy("client").agg(F.sum("n").alias("n_examples"), (F.sum("loss") / F.sum("n")).alias("loss"))
        return sums[1:] / sums[0], clients

    def close(self) -> None:
        self.rows.unpersist()


def federated_fit(
    df: DataFrame, features: Sequence[str], client: str = "client", label: str = "is_anomaly",
    hidden: Sequence[int] = (64, 32, 16), rounds: int = 5, epochs: int = 5, rate: float = 1e-3,
    seed: int = 42, scaler: str = "local", weights_path: str | None = None, batch: int = 64,
    rows_per_replica: int = ROWS_PER_REPLICA,
) -> FederatedModel:
    """Rounds of local training on each client's normals, then averaging.

    What reaches the driver is one averaged model per round and one row of totals. With ``weights_path`` each round's
    weights are added to a table there. Rows without a client are not trained on.
    """
    spark = df.sparkSession
    dims = [len(features), *hidden]
    rows = only_normal(df, label).where(F.col(client).cast("int").isNotNull())
    scalers = durable(client_scalers(rows, features, client, scaler))
    model = FederatedModel(list(features), dims, nn.start_parameters(dims, seed), scalers)
    training = ClientTraining(rows, scalers, features, client, rows_per_replica)
    try:
        for number in range(1, rounds + 1):
            model.params, clients = training.run(model.params, dims, epochs, rate, batch, seed, number)
            model.results.append(clients.withColumn("round", F.lit(number)))
            n, loss, examples = clients.agg(F.count("*"), F.avg("loss"), F.sum("n_examples")).first()
            model.history.append((number, n, loss, examples))
            if weights_path:
                spark.createDataFrame([(number, model.params.tolist())], "round int, weights array<double>").write.mode(
                    "append").parquet(weights_path)
    finally:
        training.close()
    return model


def federated_evaluate(
    df: DataFrame, model: FederatedModel, client: str = "client", label: str = "is_anomaly",
    threshold: float | None = None,
) -> DataFrame:
    """Per client: examples, ROC AUC, F1 and the loss on its normals (null without any); threshold p92 of its scores if none is given."""
    scored = model.score(df, client).select(F.col(client).cast("string").alias("client"), label, "score")
    scored = durable(scored)
    if scored.select("client").distinct().limit(MOST_EVALUATED + 1).count() > MOST_EVALUATED:
        raise ValueError(f"at most {MOST_EVALUATED} clients can be evaluated at once")
    if threshold is None:
        found = exact_quantiles(scored, "score", [FIT_PERCENTILE], ["client"])
        limits = {k[0]: v[FIT_PERCENTILE] for k, v in found.items()}
    else:
        limits = {r["client"]: threshold for r in scored.select("client").distinct().collect()}  # one row per client
    metrics = evaluate(scored, "score", label, limits, by="client").select("client", "roc_auc", "f1", "n_samples")
    loss = scored.where(~F.col(label)).groupBy("client").agg(F.avg("score").alias("loss"))
    return metrics.join(loss, "client", "left")
