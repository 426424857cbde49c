"""Rates, ratios and flags of a network flow, as column expressions over the raw columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schemas import COMMON_PORTS, SERVICE_BY_PORT, SUSPICIOUS_PORTS

# fixed values: upper limits of the rates, and the offset that keeps a rate finite
MAX_BYTES_PER_SEC = 1_000_000.0
MAX_PACKETS_PER_SEC = 10_000.0
MAX_PAYLOAD_DENSITY = 100_000.0
SECONDS_OFFSET = 0.01


def _at_most(limit: float, value: Column) -> Column:
    return F.least(value, F.lit(limit))


def bytes_out_in_ratio(out: Column, back: Column) -> Column:
    return out / (back + 1)


def bytes_per_sec(out: Column, back: Column, seconds: Column) -> Column:
    return _at_most(MAX_BYTES_PER_SEC, (out + back) / (seconds + SECONDS_OFFSET))


def bytes_per_packet(out: Column, back: Column, packets: Column) -> Column:
    return (out + back) / (packets + 1)


def is_common_port(port: Column) -> Column:
    return port.isin(COMMON_PORTS).cast("int")


def is_suspicious_port(port: Column) -> Column:
    return port.isin(SUSPICIOUS_PORTS).cast("int")


def byte_asymmetry(out: Column, back: Column) -> Column:
    return F.abs(out - back) / (out + back + 1)


def packets_per_sec(packets: Column, seconds: Column) -> Column:
    return _at_most(MAX_PACKETS_PER_SEC, packets / (seconds + SECONDS_OFFSET))


def payload_density(per_packet: Column, seconds: Column) -> Column:
    return _at_most(MAX_PAYLOAD_DENSITY, per_packet / (seconds + SECONDS_OFFSET))


def is_zero_bytes(out: Column, back: Column) -> Column:
    return (out + back == 0).cast("int")


def service_of(port: Column) -> Column:
    """Service name of a destination port; a folded map lookup, no join needed for ten entries."""
    pairs = [F.lit(item) for entry in SERVICE_BY_PORT.items() for item in entry]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), port.cast("int")), F.lit("UNKNOWN"))
