"""The three telemetry shapes (flows, metrics, logs) read off the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """One network flow per order; bytes, packets and duration come from its lines.

    The lines are summed per order before the join, so a hot order costs one partial sum per task
    rather than a long list in one of them.
    """
    price = F.floor("l_extendedprice").cast("long")
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_linestatus") == "O", price).otherwise(0)).alias("b_out"),
        F.sum(F.when(F.col("l_linestatus") == "F", price).otherwise(0)).alias("b_in"),
        F.sum(F.floor("l_quantity").cast("long")).alias("pk"),
        (F.sum("l_partkey") % 2000).alias("dur"),
    )
    raw = (
        table(spark, folder, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("flow_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.concat(
                F.lit("10.0."), (F.col("o_custkey") % 256).cast("string"),
                F.lit("."), (F.col("o_orderkey") % 256).cast("string"),
            ).alias("src_ip"),
            F.concat(F.lit("45.0.0."), (F.col("o_orderkey") % 64).cast("string")).alias("dst_ip"),
            (F.lit(49152) + F.col("o_orderkey") % 16384).cast("long").alias("src_port"),
            _port_of(F.col("o_custkey") % 12).alias("dst_port"),
            F.when(F.col("o_custkey") % 12 == 2, "UDP").otherwise("TCP").alias("protocol"),
            F.coalesce("b_out", F.lit(0).cast("long")).alias("bytes_out"),
            F.coalesce("b_in", F.lit(0).cast("long")).alias("bytes_in"),
            F.coalesce("pk", F.lit(0).cast("long")).alias("packets"),
            F.col("dur").alias("duration_ms"),
        )
    )
    out, back, port, packets = (F.col(c) for c in ("bytes_out", "bytes_in", "dst_port", "packets"))
    kind = (
        F.when(out + back == 0, "port_scan")
        .when((port == 4444) & (packets < 60), "c2_beacon")
        .when(port.isin(445, 3389) & (out > 3 * back), "lateral_movement")
        .when((port == 443) & (back == 0), "data_exfiltration")
        .when((port == 53) & (packets >= 150), "dns_tunneling")
    )
    return raw.withColumn("anomaly_type", kind).withColumn("is_anomaly", F.col("anomaly_type").isNotNull())


def _port_of(residue: Column) -> Column:
    ports = [80, 443, 53, 22, 25, 8080, 3306, 445, 3389, 4444, 6379, 60000]
    return F.get(F.lit(ports), residue.cast("int")).cast("long")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One host metric record per user and day of events."""
    def tally(kind: str) -> Column:
        return F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0))

    daily = (
        table(spark, folder, "events")
        .groupBy("user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"))
        .agg(
            F.max("value").alias("cpu_percent"),
            (F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).cast("double") / 500.0).alias("mem_percent"),
            tally("view").alias("disk_read_mbps"),
            tally("purchase").alias("disk_write_mbps"),
            tally("click").alias("net_in_mbps"),
            tally("signup").alias("net_out_mbps"),
            F.count("*").alias("open_connections"),
            tally("error").alias("process_count"),
        )
    )
    hot, forked = F.col("cpu_percent") >= 200.0, F.col("process_count") >= 3
    return daily.select(
        (F.col("user_id") * 1000 + F.dayofmonth("ts")).cast("long").alias("rec_id"),
        "ts",
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"),
        "cpu_percent", "mem_percent", "disk_read_mbps", "disk_write_mbps",
        "net_in_mbps", "net_out_mbps", "open_connections", "process_count",
        F.coalesce(hot | forked, F.lit(False)).alias("is_anomaly"),
        F.when(hot, "cpu_spike").when(forked, "process_bomb").alias("anomaly_type"),
    )


def logs(
    spark: SparkSession, folder: str, more: dict[str, Column] | None = None, message: Column | None = None, documents: DataFrame | None = None
) -> DataFrame:
    """One log record per document; documents without a label keep a null ``is_anomaly``.

    ``more`` are columns computed from the document, and ``message`` what is kept of its text, before it is joined with its
    label, so that a text that is only measured or shown in part does not move. ``documents`` may stand for the table.
    """
    documents = table(spark, folder, "documents") if documents is None else documents
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "labelled_id")
    toxic = F.col("toxic") == 1
    return (
        documents.withColumns((more or {}) | {"_message": F.col("text") if message is None else message})
        .join(labels, F.col("doc_id") == F.col("labelled_id"), "left")
        .select(
            F.col("doc_id").alias("log_id"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id"))).alias("ts"),
            "source",
            F.col("lang").alias("log_type"),
            F.col("_message").alias("message"),
            F.when(F.col("toxic").isNotNull(), toxic).alias("is_anomaly"),
            F.when(toxic & (F.col("quality") == 1), "web_shell").when(toxic, "unauthorized_access").alias("anomaly_type"),
            *(more or {}),
        )
    )


def external_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The flows in the column layout of an external flow capture."""
    return flows(spark, folder).select(
        "flow_id",
        F.col("bytes_out").alias("sbytes"), F.col("bytes_in").alias("dbytes"),
        F.col("packets").alias("spkts"), F.lit(0).cast("long").alias("dpkts"),
        (F.col("duration_ms") / 1000.0).alias("dur"),
        ((F.col("bytes_out") + F.col("bytes_in")) / (F.col("packets") + 1)).alias("smean"),
        F.col("is_anomaly").cast("int").alias("label"),
        F.coalesce("anomaly_type", F.lit("Normal")).alias("attack_cat"),
    )
