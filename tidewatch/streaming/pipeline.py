"""The batch plans on unbounded input, and their sinks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidewatch.sources.alert_store import AlertStore


def stream_jsonl(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
    format: str = "json", options: dict[str, str] | None = None,
) -> DataFrame:
    """Unbounded feed of JSON records; another ``format`` with its options is passed through."""
    reader = spark.readStream.format(format).options(**(options or {}))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if format == "json":
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def score_stream(stream: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a fitted batch plan to a stream. Its model is in the plan as literals and broadcasts."""
    if not stream.isStreaming:
        raise ValueError("score_stream needs a streaming table")
    return process(stream)


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastWrite(StatefulProcessor):
    """Per id: the last row so far, and a timer at the time when it counts as settled."""

    def __init__(self, settle_ms: int):
        self.settle_ms = settle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp, at_ms long, body string")

    def handleInputRows(self, key, rows, timerValues):
        held = self.last.get()
        best = None if held is None else (held[1], held[2])
        known = best
        for batch in rows:  # id, event time, microseconds, the row as text
            for at, body in zip(batch.iloc[:, 2].tolist(), batch.iloc[:, 3].tolist()):
                best = (at, body) if best is None or (at, body) > best else best
        if best != known:
            if known is not None:
                self.handle.deleteTimer(known[0] // 1000 + self.settle_ms)
            self.last.update((pd.Timestamp(best[0], unit="us").to_pydatetime(), best[0], best[1]))
            self.handle.registerTimer(best[0] // 1000 + self.settle_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"id": [key[0]], "_body": [held[2]]})

    def close(self) -> None:
        pass


def last_write_stream(alerts: DataFrame, settle: str = "1 hour", late: str = "10 minutes", time: str = "timestamp") -> DataFrame:
    """The last row of every id, once the watermark has passed it by ``settle``, as the batch form keeps the last.

    State holds one row per id that is not settled; a later update of a settled id is emitted again, and the alert
    store lets it replace the earlier one. Rows older than the watermark are dropped. State is kept in RocksDB.
    """
    spark = alerts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    rows = alerts.withWatermark(time, late).select(
        "id", time, F.unix_micros(F.col(time).cast("timestamp")).alias("_ms"), F.to_json(F.struct(*alerts.columns), _JSON).alias("_body"))
    settle_ms = int(spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL {settle})")).first()[0])
    kept = rows.groupBy("id").transformWithStateInPandas(_LastWrite(settle_ms), "id string, _body string", "Append", "EventTime")
    return kept.select(F.from_json("_body", alerts.schema, _JSON).alias("a")).select("a.*")


def write_alert_stream(
    alerts: DataFrame, path: str, checkpoint: str, available_now: bool = False, trigger: str = "10 seconds"
) -> StreamingQuery:
    """Append alerts to Parquet files, each exactly once by the sink's own log."""
    dated = alerts.withColumn("date", F.to_date("timestamp"))
    writer = dated.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.partitionBy("modality", "date")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start(path)


def write_alert_batches(
    alerts: DataFrame, path: str, checkpoint: str, available_now: bool = False, trigger: str = "10 seconds",
    source: str = "stream",
) -> StreamingQuery:
    """Every micro-batch updates the alert store at ``path`` by id; one that is replayed changes nothing."""
    store = AlertStore(alerts.sparkSession, path)
    writer = alerts.writeStream.foreachBatch(lambda batch, number: store.upsert(batch, source, number)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
