"""Cleaning, feature selection, network features and record tagging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import network as net
from tidewatch.functions import records
from tidewatch.schemas import FLOW_FEATURES


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")


def select_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The feature columns as doubles with nulls as 0; an absent column is an error."""
    require_columns(df, columns)
    return df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def fill_missing(df: DataFrame, columns: Sequence[str], value: float = 0) -> DataFrame:
    """Absent columns and nulls both become ``value``."""
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(value)) if c in df.columns else F.lit(value) for c in columns
    })


def add_network_features(df: DataFrame) -> DataFrame:
    """The nine derived flow features next to the raw columns, which stay as they are."""
    def raw(name: str):
        return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)

    out, back, packets, port = raw("bytes_out"), raw("bytes_in"), raw("packets"), raw("dst_port")
    seconds = raw("duration_ms") / 1000.0
    per_packet = net.bytes_per_packet(out, back, packets)
    return df.withColumns({
        "bytes_out_in_ratio": net.bytes_out_in_ratio(out, back),
        "bytes_per_sec": net.bytes_per_sec(out, back, seconds),
        "bytes_per_packet": per_packet,
        "is_common_port": net.is_common_port(port),
        "is_suspicious_port": net.is_suspicious_port(port),
        "byte_asymmetry": net.byte_asymmetry(out, back),
        "packets_per_sec": net.packets_per_sec(packets, seconds),
        "payload_density": net.payload_density(per_packet, seconds),
        "is_zero_bytes": net.is_zero_bytes(out, back),
    })


def map_flow_csv(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """An external flow capture in the 15 feature columns.

    It has no ports, so these and their flags are 0, and its payload density comes from the mean
    packet size it reports itself.
    """
    def at_least_zero(name: str):
        return F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0))

    out, back, seconds = at_least_zero("sbytes"), at_least_zero("dbytes"), at_least_zero("dur")
    packets = at_least_zero("spkts") + at_least_zero("dpkts")
    values = {
        "bytes_out": out,
        "bytes_in": back,
        "packets": packets,
        "duration_ms": seconds * 1000,
        "src_port": F.lit(0),
        "dst_port": F.lit(0),
        "bytes_out_in_ratio": net.bytes_out_in_ratio(out, back),
        "bytes_per_sec": net.bytes_per_sec(out, back, seconds),
        "bytes_per_packet": net.bytes_per_packet(out, back, packets),
        "is_common_port": F.lit(0),
        "is_suspicious_port": F.lit(0),
        "byte_asymmetry": net.byte_asymmetry(out, back),
        "packets_per_sec": net.packets_per_sec(packets, seconds),
        "payload_density": net.payload_density(F.coalesce(F.col("smean"), F.lit(0.0)), seconds),
        "is_zero_bytes": net.is_zero_bytes(out, back),
    }
    return df.select(*keep, *[values[name].alias(name) for name in FLOW_FEATURES])


def service_name(df: DataFrame, port: str = "dst_port", name: str = "service") -> DataFrame:
    return df.withColumn(name, net.service_of(F.col(port)))


def classify_log_message(df: DataFrame, rules=tuple(records.LOG_RULES), name: str = "anomaly_type") -> DataFrame:
    return df.withColumn(name, records.log_anomaly_type(F.col("log_type"), F.col("message"), rules))


def message_length(df: DataFrame, name: str = "message_length") -> DataFrame:
    return df.withColumn(name, F.length("message"))


def source_of(df: DataFrame, name: str = "origin") -> DataFrame:
    return df.withColumn(name, records.origin(df.columns))


def only_normal(df: DataFrame, label: str = "is_anomaly") -> DataFrame:
    """Training subset: records known to be normal. Unlabelled records are left out."""
    return df.where(~F.col(label).cast("boolean"))
