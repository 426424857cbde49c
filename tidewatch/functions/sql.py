"""The closed-form functions as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewatch.functions.fusion import EPS
from tidewatch.functions.network import MAX_BYTES_PER_SEC, MAX_PACKETS_PER_SEC, MAX_PAYLOAD_DENSITY, SECONDS_OFFSET
from tidewatch.schemas import COMMON_PORTS, RATIO_WEIGHTS, SEVERITIES, SUPERVISED_WEIGHTS, SUSPICIOUS_PORTS


def _listed(values) -> str:
    return ", ".join(str(v) for v in values)


def _clip(x: str, low: float, high: float) -> str:
    return f"if({x} IS NULL, NULL, greatest(least({x}, {high}D), {low}D))"


def sql_functions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, return type, body)"""
    bytes_ = "out_bytes DOUBLE, in_bytes DOUBLE"
    total = "(out_bytes + in_bytes)"
    rank = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES, start=1))
    a, b = SUPERVISED_WEIGHTS
    c, d = RATIO_WEIGHTS
    return {
        "bytes_out_in_ratio": (bytes_, "DOUBLE", "out_bytes / (in_bytes + 1)"),
        "bytes_per_sec": (f"{bytes_}, seconds DOUBLE", "DOUBLE",
                          f"least({total} / (seconds + {SECONDS_OFFSET}D), {MAX_BYTES_PER_SEC}D)"),
        "bytes_per_packet": (f"{bytes_}, packets DOUBLE", "DOUBLE", f"{total} / (packets + 1)"),
        "is_common_port": ("port BIGINT", "INT", f"CAST(port IN ({_listed(COMMON_PORTS)}) AS INT)"),
        "is_suspicious_port": ("port BIGINT", "INT", f"CAST(port IN ({_listed(SUSPICIOUS_PORTS)}) AS INT)"),
        "byte_asymmetry": (bytes_, "DOUBLE", f"abs(out_bytes - in_bytes) / ({total} + 1)"),
        "packets_per_sec": ("packets DOUBLE, seconds DOUBLE", "DOUBLE",
                            f"least(packets / (seconds + {SECONDS_OFFSET}D), {MAX_PACKETS_PER_SEC}D)"),
        "payload_density": ("per_packet DOUBLE, seconds DOUBLE", "DOUBLE",
                            f"least(per_packet / (seconds + {SECONDS_OFFSET}D), {MAX_PAYLOAD_DENSITY}D)"),
        "is_zero_bytes": (bytes_, "INT", f"CAST({total} = 0 AS INT)"),
        "severity_rank": ("severity STRING", "INT", f"CASE severity {rank} ELSE 0 END"),
        "fuse_supervised": ("p DOUBLE, err DOUBLE, err_threshold DOUBLE", "DOUBLE",
                            f"{a}D * {_clip('p', 0, 1)} + {b}D * "
                            + _clip(f"(err / greatest(err_threshold, {EPS}D))", 0, 3) + " / 3"),
        "fuse_threshold_ratio": ("s1 DOUBLE, s2 DOUBLE, t1 DOUBLE, t2 DOUBLE", "DOUBLE",
                                 _clip(f"(({c}D * " + _clip(f"(s1 / greatest(t1, {EPS}D))", 0, 3) + f" + {d}D * "
                                       + _clip(f"(s2 / greatest(t2, {EPS}D))", 0, 3) + ") / 2)", 0, 1)),
        "bounds_normalized": ("score DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE",
                              _clip(f"((score - low) / (high - low + {EPS}D))", 0, 1)),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; they are inlined into the plan, so nothing leaves codegen."""
    functions = sql_functions()
    for name, (parameters, kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(functions)
