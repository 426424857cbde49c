"""Small per-record expressions: text rules, origin, label, severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schemas import SEVERITIES

# fixed values: (log type, text looked for, anomaly type), first match wins; None matches any message
LOG_RULES: list[tuple[str, str | None, str]] = [
    ("syslog", "Failed", "brute_force"),
    ("syslog", None, "privilege_escalation"),
    ("auth", "Invalid", "invalid_user"),
    ("auth", None, "auth_failure"),
    ("apache", "passwd", "path_traversal"),
    ("apache", "UNION", "sqli"),
    ("apache", "cmd=", "web_shell"),
    ("apache", None, "unauthorized_access"),
]


def log_anomaly_type(
    log_type: Column, message: Column, rules: Sequence[tuple[str, str | None, str]] = tuple(LOG_RULES)
) -> Column:
    """First matching rule as one CASE expression; null when no rule applies."""
    chosen = None
    for kind, needle, outcome in rules:
        test = log_type == kind
        if needle is not None:
            test = test & message.contains(needle)
        chosen = F.when(test, outcome) if chosen is None else chosen.when(test, outcome)
    return chosen


def origin(columns: Sequence[str]) -> Column:
    """Where a record came from: source, else host, else source address, else 'unknown'."""
    known = [F.col(c) for c in ("source", "host", "src_ip") if c in columns]
    return F.coalesce(*known, F.lit("unknown"))


def label_int(label: Column) -> Column:
    return label.cast("int")


def severity_rank(severity: Column) -> Column:
    """low 1 up to critical 4; anything else 0."""
    rank = F.lit(0)
    for position, name in enumerate(SEVERITIES, start=1):
        rank = F.when(severity == name, position).otherwise(rank)
    return rank


def uniform_hash(key: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) per key, the same on any partitioning and in any SQL engine with md5."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("long") / F.lit(float(16 ** 13))
