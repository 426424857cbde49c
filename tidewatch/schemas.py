"""Declared record types, feature lists and default parameters."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _B, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# ---- fixed values: feature lists, ports and services -------------------------------------------
METRIC_FEATURES = [
    "cpu_percent", "mem_percent", "disk_read_mbps", "disk_write_mbps",
    "net_in_mbps", "net_out_mbps", "open_connections", "process_count",
]
RAW_FLOW_FEATURES = ["bytes_out", "bytes_in", "packets", "duration_ms", "src_port", "dst_port"]
DERIVED_FLOW_FEATURES = [
    "bytes_out_in_ratio", "bytes_per_sec", "bytes_per_packet", "is_common_port", "is_suspicious_port",
    "byte_asymmetry", "packets_per_sec", "payload_density", "is_zero_bytes",
]
FLOW_FEATURES = RAW_FLOW_FEATURES + DERIVED_FLOW_FEATURES
COMMON_PORTS = [80, 443, 53, 22, 25, 587, 8080, 3306, 5432, 6379]
SUSPICIOUS_PORTS = [23, 3389, 445, 135, 4444, 1337, 31337, 6666, 9001, 9030]
SERVICE_BY_PORT = {
    80: "HTTP", 443: "HTTPS", 53: "DNS", 22: "SSH", 25: "SMTP",
    587: "SUBMISSION", 8080: "HTTP-ALT", 3306: "MYSQL", 5432: "POSTGRES", 6379: "REDIS",
}
SEVERITIES = ["low", "medium", "high", "critical"]
MODALITIES = ["log", "metric", "network"]

# ---- fixed values: default parameters ----------------------------------------------------------
FUSION_WEIGHTS = {"if_score": 0.30, "ae_score": 0.30, "bert_score": 0.40}
SUPERVISED_WEIGHTS = (0.7, 0.3)
RATIO_WEIGHTS = (0.5, 0.5)
LOG_THRESHOLD = 0.5
FIT_PERCENTILE = 0.92
RECALL_FLOORS = {"metric": 0.0, "network": 0.90}
PERCENTILES = [0.50, 0.70, 0.80, 0.85, 0.90, 0.95, 0.99]

# ---- fixed values: record types; names and order of their fields ------------------------------------------------------------------------------
LOG_SCHEMA = _struct(
    ("timestamp", _TS), ("log_type", _S), ("message", _S),
    ("is_anomaly", _B), ("anomaly_type", _S), ("source", _S),
)
METRIC_SCHEMA = _struct(
    ("timestamp", _TS), ("host", _S), ("tick", _L),
    ("cpu_percent", _D), ("mem_percent", _D), ("disk_read_mbps", _D), ("disk_write_mbps", _D),
    ("net_in_mbps", _D), ("net_out_mbps", _D), ("open_connections", _L), ("process_count", _L),
    ("is_anomaly", _B), ("anomaly_type", _S),
)
FLOW_SCHEMA = _struct(
    ("timestamp", _TS), ("src_ip", _S), ("dst_ip", _S), ("src_port", _L), ("dst_port", _L),
    ("protocol", _S), ("bytes_out", _L), ("bytes_in", _L), ("packets", _L), ("duration_ms", _L),
    ("service", _S), ("is_anomaly", _B), ("anomaly_type", _S),
)
EXTERNAL_FLOW_SCHEMA = _struct(
    ("sbytes", _L), ("dbytes", _L), ("spkts", _L), ("dpkts", _L),
    ("dur", _D), ("smean", _D), ("label", T.IntegerType()), ("attack_cat", _S),
)
ATTRIBUTION_TYPE = T.ArrayType(_struct(("feature", _S), ("value", _D)))
ALERT_SCHEMA = _struct(
    ("id", _S), ("timestamp", _TS), ("source", _S), ("modality", _S), ("anomaly_type", _S),
    ("fused_score", _D), ("severity", _S), ("is_acknowledged", _B),
    ("mitre_tactic", _S), ("mitre_tactic_id", _S), ("mitre_technique", _S), ("mitre_technique_id", _S),
    ("description", _S), ("recommended_action", _S),
    ("top_features", T.ArrayType(_S)), ("feature_values", T.MapType(_S, _S)),
    ("shap_attribution", ATTRIBUTION_TYPE), ("narrative", _S), ("raw_record", _S),
)
ACK_SCHEMA = _struct(("alert_id", _S), ("acknowledged_by", _S), ("note", _S), ("acknowledged_at", _TS))
ROUND_SCHEMA = _struct(
    ("round", T.IntegerType()), ("n_clients", T.IntegerType()), ("avg_loss", _D), ("total_examples", _L),
)
