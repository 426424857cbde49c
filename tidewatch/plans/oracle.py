"""SQL text that gives the same results as the registered queries, for another engine to check them."""

from __future__ import annotations

from tidewatch.detectors.iforest import PRIME, tree_multipliers
from tidewatch.functions.records import LOG_RULES
from tidewatch.operators.knowledge import KNOWLEDGE, KNOWLEDGE_COLUMNS, UNKNOWN
from tidewatch.schemas import (
    COMMON_PORTS,
    DERIVED_FLOW_FEATURES,
    FLOW_FEATURES,
    FUSION_WEIGHTS,
    METRIC_FEATURES,
    PERCENTILES,
    SERVICE_BY_PORT,
    SUSPICIOUS_PORTS,
)

FLOWS = """
SELECT f.*,
  CASE WHEN bytes_out + bytes_in = 0 THEN 'port_scan'
       WHEN dst_port = 4444 AND packets < 60 THEN 'c2_beacon'
       WHEN dst_port IN (445, 3389) AND bytes_out > 3 * bytes_in THEN 'lateral_movement'
       WHEN dst_port = 443 AND bytes_in = 0 THEN 'data_exfiltration'
       WHEN dst_port = 53 AND packets >= 150 THEN 'dns_tunneling' END AS anomaly_type,
  CASE WHEN bytes_out + bytes_in = 0
         OR (dst_port = 4444 AND packets < 60)
         OR (dst_port IN (445, 3389) AND bytes_out > 3 * bytes_in)
         OR (dst_port = 443 AND bytes_in = 0)
         OR (dst_port = 53 AND packets >= 150) THEN true ELSE false END AS is_anomaly
FROM (
  SELECT o.o_orderkey AS flow_id,
    CAST(o.o_orderdate AS TIMESTAMP) AS ts,
    concat('10.0.', CAST(o.o_custkey % 256 AS STRING), '.', CAST(o.o_orderkey % 256 AS STRING)) AS src_ip,
    concat('45.0.0.', CAST(o.o_orderkey % 64 AS STRING)) AS dst_ip,
    CAST(49152 + o.o_orderkey % 16384 AS BIGINT) AS src_port,
    CAST(CASE o.o_custkey % 12 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22
      WHEN 4 THEN 25 WHEN 5 THEN 8080 WHEN 6 THEN 3306 WHEN 7 THEN 445 WHEN 8 THEN 3389
      WHEN 9 THEN 4444 WHEN 10 THEN 6379 ELSE 60000 END AS BIGINT) AS dst_port,
    CASE WHEN o.o_custkey % 12 = 2 THEN 'UDP' ELSE 'TCP' END AS protocol,
    coalesce(l.b_out, 0) AS bytes_out, coalesce(l.b_in, 0) AS bytes_in,
    coalesce(l.pk, 0) AS packets, l.dur AS duration_ms
  FROM orders o LEFT JOIN (
    SELECT l_orderkey,
      CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS b_out,
      CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS b_in,
      CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS pk,
      CAST(sum(l_partkey) % 2000 AS BIGINT) AS dur
    FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey) f
"""

METRICS = """
SELECT m.*,
  CASE WHEN cpu_percent >= 200.0 OR process_count >= 3 THEN true ELSE false END AS is_anomaly,
  CASE WHEN cpu_percent >= 200.0 THEN 'cpu_spike' WHEN process_count >= 3 THEN 'process_bomb' END AS anomaly_type
FROM (
  SELECT CAST(user_id * 1000 + day_no AS BIGINT) AS rec_id, ts, concat('host-', CAST(user_id AS STRING)) AS host,
    cpu_percent, mem_percent, disk_read_mbps, disk_write_mbps, net_in_mbps, net_out_mbps, open_connections, process_count
  FROM (
    SELECT user_id, date_trunc('day', ts) AS ts, CAST(extract(DAY FROM date_trunc('day', ts)) AS BIGINT) AS day_no,
      max(value) AS cpu_percent,
      CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 500.0 AS mem_percent,
      CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS disk_read_mbps,
      CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS disk_write_mbps,
      CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS net_in_mbps,
      CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS net_out_mbps,
      CAST(count(*) AS BIGINT) AS open_connections,
      CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS process_count
    FROM events GROUP BY user_id, date_trunc('day', ts)) g) m
"""

LOGS = """
SELECT d.doc_id AS log_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id) AS ts,
  d.source AS source, d.lang AS log_type, d.text AS message,
  CASE WHEN l.toxic IS NULL THEN NULL WHEN l.toxic = 1 THEN true ELSE false END AS is_anomaly,
  CASE WHEN l.toxic = 1 AND l.quality = 1 THEN 'web_shell' WHEN l.toxic = 1 THEN 'unauthorized_access' END AS anomaly_type
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def _in(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"


def network_columns(out: str, back: str, packets: str, seconds: str, port: str) -> dict[str, str]:
    total = f"({out} + {back})"
    return {
        "bytes_out_in_ratio": f"{out} / ({back} + 1)",
        "bytes_per_sec": f"least({total} / ({seconds} + 0.01), 1e6)",
        "bytes_per_packet": f"{total} / ({packets} + 1)",
        "is_common_port": f"CASE WHEN {port} IN {_in(COMMON_PORTS)} THEN 1 ELSE 0 END",
        "is_suspicious_port": f"CASE WHEN {port} IN {_in(SUSPICIOUS_PORTS)} THEN 1 ELSE 0 END",
        "byte_asymmetry": f"abs({out} - {back}) / ({total} + 1)",
        "packets_per_sec": f"least({packets} / ({seconds} + 0.01), 1e4)",
        "payload_density": f"least({total} / ({packets} + 1) / ({seconds} + 0.01), 1e5)",
        "is_zero_bytes": f"CASE WHEN {total} = 0 THEN 1 ELSE 0 END",
    }


_SECONDS = "(coalesce(duration_ms, 0) / 1000.0)"
_NET = network_columns("bytes_out", "bytes_in", "packets", _SECONDS, "dst_port")
FEATURES = "SELECT *, " + ", ".join(f"{sql} AS {c}" for c, sql in _NET.items()) + " FROM flows"


def stats_cte(source: str, features, where: str = "NOT is_anomaly") -> str:
    parts = []
    for c in features:
        x = f"CAST(coalesce({c}, 0) AS DOUBLE)"
        parts.append(f"avg({x}) AS m_{c}, CASE WHEN stddev_pop({x}) = 0 THEN 1.0 ELSE stddev_pop({x}) END AS s_{c}")
    return f"SELECT {', '.join(parts)} FROM {source} WHERE {where}"


def z(c: str) -> str:
    return f"((CAST(coalesce({c}, 0) AS DOUBLE) - m_{c}) / s_{c})"


def zscore(features) -> str:
    return "(" + " + ".join(f"pow({z(c)}, 2)" for c in features) + f") / {len(features)}"


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes) + "\n" + final


C_FLOWS = [("flows", FLOWS), ("feats", FEATURES)]
C_METRICS = [("metrics", METRICS)]
C_LOGS = [("logs", LOGS)]
C_FLOW_SCORED = C_FLOWS + [
    ("fstats", stats_cte("feats", FLOW_FEATURES)),
    ("fscored", f"SELECT feats.*, {zscore(FLOW_FEATURES)} AS score FROM feats, fstats"),
    ("flimit", "SELECT quantile_cont(score, 0.92) AS t FROM fscored WHERE NOT is_anomaly"),
    ("fpred", "SELECT fscored.*, t, CASE WHEN score >= t THEN 1 ELSE 0 END AS prediction FROM fscored, flimit"),
]
C_METRIC_SCORED = C_METRICS + [
    ("mstats", stats_cte("metrics", METRIC_FEATURES)),
    ("mscored", f"SELECT metrics.*, {zscore(METRIC_FEATURES)} AS score FROM metrics, mstats"),
    ("mlimit", "SELECT quantile_cont(score, 0.92) AS t FROM mscored WHERE NOT is_anomaly"),
    ("mpred", "SELECT mscored.*, t, CASE WHEN score >= t THEN 1 ELSE 0 END AS prediction FROM mscored, mlimit"),
]
C_LOG_SCORED = C_LOGS + [
    ("lrows", "SELECT *, length(message) AS message_length FROM logs"),
    ("lstats", stats_cte("lrows", ["message_length"])),
    ("lscored", f"SELECT lrows.*, {zscore(['message_length'])} AS score FROM lrows, lstats"),
    ("llimit", "SELECT quantile_cont(score, 0.92) AS t FROM lscored WHERE NOT is_anomaly"),
    ("lpred", "SELECT lscored.*, t, coalesce(is_anomaly, score >= t) AS raised FROM lscored, llimit"),
]
_THREE = ["if_score", "ae_score", "bert_score"]
C_THREE = C_METRICS + [
    ("mstats", stats_cte("metrics", METRIC_FEATURES)),
    ("three", f"""SELECT metrics.*, {zscore(METRIC_FEATURES[:4])} AS if_score, {zscore(METRIC_FEATURES)} AS ae_score,
       CASE WHEN open_connections > 1 THEN {zscore(METRIC_FEATURES[4:])} END AS bert_score FROM metrics, mstats"""),
    ("limits", "SELECT " + ", ".join(f"quantile_cont({c}, 0.92) AS t_{c}" for c in _THREE) + " FROM three WHERE NOT is_anomaly"),
]


def _quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


KB = ("kb", "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(_quote(v) for v in row) + ")" for row in KNOWLEDGE
) + f") AS k({', '.join('kb_' + c for c in KNOWLEDGE_COLUMNS)})")


def _kb(column: str) -> str:
    return f"coalesce(kb_{column}, {_quote(UNKNOWN[KNOWLEDGE_COLUMNS.index(column)])})"


def alert_rows(source: str, modality: str, key: str, origin: str, where: str, top: str, score: str = "score") -> str:
    return f"""SELECT md5('{modality}|' || CAST({key} AS STRING)) AS id, ts AS timestamp, {origin} AS source,
      '{modality}' AS modality, coalesce(anomaly_type, 'unknown') AS anomaly_type,
      round({score}, 4) AS fused_score, {_kb('severity')} AS severity, false AS is_acknowledged,
      {_kb('tactic')} AS mitre_tactic, {_kb('tactic_id')} AS mitre_tactic_id,
      {_kb('technique')} AS mitre_technique, {_kb('technique_id')} AS mitre_technique_id,
      {_kb('description')} AS description, {_kb('recommended_action')} AS recommended_action,
      {top} AS top_features
    FROM {source} s LEFT JOIN kb ON coalesce(s.anomaly_type, 'unknown') = kb_anomaly_type WHERE {where}"""


def _contributions() -> str:
    d = len(METRIC_FEATURES)
    selects = [
        f"SELECT rec_id, '{c}' AS feature, {i} AS pos, "
        f"round(pow({z(c)}, 2) / {d} - (CASE WHEN dev_{c} > 0 THEN 1.0 ELSE 0.0 END) / CAST({d} AS DOUBLE), 6) AS value "
        f"FROM mpred, mstats, mdev WHERE prediction = 1"
        for i, c in enumerate(METRIC_FEATURES)
    ]
    return " UNION ALL ".join(selects)


C_ATTRIBUTION = C_METRIC_SCORED + [
    ("mdev", "SELECT " + ", ".join(f"stddev_pop({c}) AS dev_{c}" for c in METRIC_FEATURES) + " FROM metrics WHERE NOT is_anomaly"),
    ("contrib", _contributions()),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY abs(value) DESC, pos) - 1 AS place FROM contrib"),
    ("top3", "SELECT rec_id, string_agg(feature, ',' ORDER BY place) AS top_features FROM ranked WHERE place < 3 GROUP BY rec_id"),
]
C_FLOW_ALERTS = C_FLOW_SCORED + [
    KB, ("falerts", alert_rows("fpred", "network", "flow_id", "src_ip", "prediction = 1", "'src_ip,dst_ip,dst_port'")),
]
C_METRIC_ALERTS = C_ATTRIBUTION + [
    KB,
    ("mtop", "SELECT mpred.*, top_features AS tops FROM mpred JOIN top3 USING (rec_id)"),
    ("malerts", alert_rows("mtop", "metric", "rec_id", "host", "prediction = 1", "tops")),
]
C_LOG_ALERTS = C_LOG_SCORED + [
    ("lalerts", alert_rows("lpred", "log", "log_id", "s.source", "raised", "'source,log_type,message_length'")),
]
C_ALL_ALERTS = C_FLOW_ALERTS + [c for c in C_METRIC_ALERTS if c is not KB] + C_LOG_ALERTS + [
    ("alerts", "SELECT * FROM falerts UNION ALL SELECT * FROM malerts UNION ALL SELECT * FROM lalerts"),
]
ACKS = ("acks", """SELECT md5('network|' || CAST(l_orderkey AS STRING)) AS alert_id,
   'operator-' || CAST(l_suppkey % 5 AS STRING) AS acknowledged_by,
   CASE WHEN l_returnflag = 'R' THEN 'false alarm' END AS note, CAST(l_shipdate AS TIMESTAMP) AS acknowledged_at
   FROM lineitem""")
_SEVERITY_ROWS = "(VALUES ('low'), ('medium'), ('high'), ('critical')) AS s(severity)"


# ---- ranking ------------------------------------------------------------------------------------

def points_ctes(source: str, score: str, label: str, by: str = "") -> list[tuple[str, str]]:
    """Distinct scores with running hits and false alarms from the top."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return [
        ("counts", f"""SELECT {g}CAST({score} AS DOUBLE) AS score, CAST(sum(CASE WHEN {label} THEN 1 ELSE 0 END) AS BIGINT) AS pos,
           CAST(sum(CASE WHEN {label} THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM {source}
           WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY {g}{score}"""),
        ("points", f"""SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) AS tp, sum(neg) OVER ({part}ORDER BY score DESC) AS fp,
           sum(pos) OVER ({part}) AS n_pos, sum(neg) OVER ({part}) AS n_neg FROM counts"""),
    ]


_AUC = """CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0
  THEN sum(CAST(neg AS DOUBLE) * (tp - pos) + CAST(neg AS DOUBLE) * pos / 2) / (CAST(max(n_pos) AS DOUBLE) * max(n_neg)) ELSE 0.0 END"""
_AP = "CASE WHEN max(n_pos) > 0 THEN sum(pos * (tp / (tp + fp))) / max(n_pos) ELSE 0.0 END"


def best_f1(min_recall: float, by: str = "") -> str:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {g}score AS threshold, f1, r AS recall FROM (
      SELECT *, row_number() OVER ({part}ORDER BY f1 DESC, score) AS place FROM (
        SELECT *, 2 * p * r / (p + r + 1e-9) AS f1 FROM (
          SELECT *, tp / (tp + fp) AS p, tp / n_pos AS r FROM points)) WHERE r >= {min_recall}) WHERE place = 1"""


def evaluation(limit: str, by: str = "") -> str:
    """Metric row over ``points`` against the threshold expression ``limit``."""
    g = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {g}round(auc, 4) AS roc_auc, round(ap, 4) AS avg_precision, round(p, 4) AS precision, round(r, 4) AS recall,
      round(2 * p * r / greatest(p + r, 1e-8), 4) AS f1,
      round((tp_ + tn_) / (tp_ + fp_ + fn_ + tn_), 4) AS accuracy,
      tp_ + fp_ + fn_ + tn_ AS n_samples, tp_ + fn_ AS n_true, tp_ + fp_ AS n_pred
    FROM (SELECT *, tp_ / greatest(tp_ + fp_, 1) AS p, tp_ / greatest(tp_ + fn_, 1) AS r FROM (
      SELECT {g}{_AUC} AS auc, {_AP} AS ap,
        CAST(sum(CASE WHEN score >= {limit} THEN pos ELSE 0 END) AS BIGINT) AS tp_,
        CAST(sum(CASE WHEN score >= {limit} THEN neg ELSE 0 END) AS BIGINT) AS fp_,
        CAST(sum(CASE WHEN score >= {limit} THEN 0 ELSE pos END) AS BIGINT) AS fn_,
        CAST(sum(CASE WHEN score >= {limit} THEN 0 ELSE neg END) AS BIGINT) AS tn_
      FROM points {group}))"""


_CONFUSION = """SELECT
   CAST(coalesce(sum(CASE WHEN is_anomaly AND prediction = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp,
   CAST(coalesce(sum(CASE WHEN NOT is_anomaly AND prediction = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fp,
   CAST(coalesce(sum(CASE WHEN is_anomaly AND prediction = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fn,
   CAST(coalesce(sum(CASE WHEN NOT is_anomaly AND prediction = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tn
   FROM fpred"""


def _report() -> str:
    def ratio(a: str, b: str) -> str:
        return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"

    return with_ctes(C_FLOW_SCORED + [
        ("c", _CONFUSION),
        ("sides", "SELECT '0' AS class, tn AS ok, fn AS wrong, fp AS lost FROM c UNION ALL SELECT '1', tp, fp, fn FROM c"),
        ("pr", f"SELECT class, {ratio('ok', 'ok + wrong')} AS p, {ratio('ok', 'ok + lost')} AS r, ok + lost AS n FROM sides"),
        ("prf", f"SELECT *, {ratio('2 * p * r', 'p + r')} AS f FROM pr"),
        ("acc", "SELECT (tp + tn) / (tp + fp + fn + tn) AS a, tp + fp + fn + tn AS n FROM c"),
    ], """SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, n AS support FROM prf
      UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n FROM acc
      UNION ALL SELECT 'macro avg', round(sum(p) / 2, 6), round(sum(r) / 2, 6), round(sum(f) / 2, 6), CAST(sum(n) AS BIGINT) FROM prf
      UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 6), round(sum(r * n) / sum(n), 6), round(sum(f * n) / sum(n), 6),
        CAST(sum(n) AS BIGINT) FROM prf""")


# ---- fusion -------------------------------------------------------------------------------------

def scaled_ctes(source: str = "three", names=tuple(_THREE)) -> list[tuple[str, str]]:
    ranges = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, count({c}) AS n_{c}" for c in names)
    scaled = ", ".join(
        f"CASE WHEN n_{c} <= 1 THEN {c} WHEN hi_{c} - lo_{c} < 1e-8 THEN {c} * 0 ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END AS u_{c}"
        for c in names
    )
    return [("ranges", f"SELECT {ranges} FROM {source}"), ("scaled", f"SELECT {source}.*, {scaled} FROM {source}, ranges")]


def weighted_sql(names=tuple(_THREE)) -> str:
    top = " + ".join(f"coalesce(u_{c} * {FUSION_WEIGHTS[c]}, 0.0)" for c in names)
    low = " + ".join(f"CASE WHEN u_{c} IS NULL THEN 0.0 ELSE {FUSION_WEIGHTS[c]} END" for c in names)
    return f"(({top}) / nullif(CAST({low} AS DOUBLE), 0))"


_FUSED = {
    "weighted_avg": weighted_sql(),
    "max": "greatest(" + ", ".join(f"u_{c}" for c in _THREE) + ")",
    "vote": "((" + " + ".join(f"CASE WHEN u_{c} >= 0.5 THEN 1 ELSE 0 END" for c in _THREE) + ") / nullif("
            + " + ".join(f"CASE WHEN u_{c} IS NULL THEN 0 ELSE 1 END" for c in _THREE) + ", 0))",
}


def _fuse(strategy: str) -> str:
    return with_ctes(C_THREE + scaled_ctes(), f"""SELECT rec_id, round(f, 6) AS fused_score,
      CASE WHEN f >= 0.5 THEN 1 WHEN f < 0.5 THEN 0 END AS is_anomaly_pred FROM (SELECT rec_id, {_FUSED[strategy]} AS f FROM scaled)""")


def _clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, {high}.0), {low}.0) END"


_SUPERVISED = f"(0.7 * ({_clip('sup', 0, 1)}) + 0.3 * (({_clip('(rec / greatest(t_rec, 1e-8))', 0, 3)}) / 3))"
_RATIO = (f"((0.5 * ({_clip('(iso / greatest(t_iso, 1e-8))', 0, 3)}) + 0.5 * "
          f"({_clip('(rec / greatest(t_rec, 1e-8))', 0, 3)})) / 2)")


def _uniform(key: str, seed: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS STRING)), 1, 13) AS BIGINT) / CAST({16 ** 13} AS DOUBLE))"


def _forest(trees: int = 200, sample: int = 256, seed: int = 42) -> str:
    """Grow the same isolation forest on the normal metrics by recursion over levels, and walk it with every record."""
    d = len(METRIC_FEATURES)
    values = "[" + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE)" for c in METRIC_FEATURES) + "]"

    def chance(what: str) -> str:
        return f"(CAST('0x' || substr(md5('{seed}:' || t || ':' || node || ':{what}'), 1, 13) AS BIGINT) / CAST({16 ** 13} AS DOUBLE))"

    path = "CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0 ELSE 2.0 * (ln(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n END"
    lows, highs = ("[" + ", ".join(f"{f}(x[{i}]) OVER w" for i in range(1, d + 1)) + "]" for f in ("min", "max"))
    group_lows, group_highs = ("[" + ", ".join(f"{f}(x[{i}])" for i in range(1, d + 1)) + "]" for f in ("min", "max"))
    usable = f"list_filter(range(1, {d + 1}), lambda i: highs[i] > lows[i])"
    feature = f"CASE WHEN depth < deepest AND len(usable) > 0 THEN usable[1 + CAST(floor({chance('feature')} * len(usable)) AS BIGINT)] END"
    split = f"lows[feature] + {chance('split')} * (highs[feature] - lows[feature])"
    factors = ", ".join(f"({t}, {a}, {b})" for t, (a, b) in enumerate(tree_multipliers(trees, seed)))
    return f"""WITH RECURSIVE metrics AS ({METRICS}), trees(t, a, b) AS (VALUES {factors}),
      normals AS (SELECT rec_id, {values} AS x, CAST('0x' || substr(md5('{seed}:' || rec_id), 1, 7) AS BIGINT) AS h FROM metrics WHERE NOT is_anomaly),
      used AS (SELECT least({sample}, count(*)) AS used, greatest(1, CAST(ceil(log2(greatest(2, least({sample}, count(*))))) AS INTEGER)) AS deepest FROM normals),
      drawn AS (SELECT t, x, used, deepest FROM normals, trees, used
        QUALIFY row_number() OVER (PARTITION BY t ORDER BY (a * h + b) % {PRIME}, CAST(rec_id AS VARCHAR)) <= used),
      placed AS (
        SELECT t, x, deepest, CAST(0 AS BIGINT) AS node, 0 AS depth FROM drawn
        UNION ALL
        SELECT t, x, deepest, CASE WHEN x[feature] <= split THEN 2 * node + 1 ELSE 2 * node + 2 END, depth + 1
        FROM (SELECT *, {split} AS split FROM (SELECT *, {feature} AS feature FROM (SELECT *, {usable} AS usable FROM (
          SELECT *, {lows} AS lows, {highs} AS highs FROM placed WINDOW w AS (PARTITION BY t, node))))) WHERE feature IS NOT NULL
      ),
      nodes AS (SELECT t, node, feature, {split} AS split, depth + {path} AS path FROM (SELECT *, {feature} AS feature FROM (SELECT *, {usable} AS usable FROM (
        SELECT t, node, depth, deepest, count(*) AS n, {group_lows} AS lows, {group_highs} AS highs FROM placed GROUP BY t, node, depth, deepest)))),
      walk AS (
        SELECT rec_id, {values} AS x, t, CAST(0 AS BIGINT) AS node FROM metrics, trees
        UNION ALL
        SELECT rec_id, x, t, CASE WHEN x[feature] <= split THEN 2 * node + 1 ELSE 2 * node + 2 END FROM walk JOIN nodes USING (t, node) WHERE feature IS NOT NULL
      ),
      ends AS (SELECT rec_id, avg(path) AS mean_path FROM walk JOIN nodes USING (t, node) WHERE feature IS NULL GROUP BY rec_id),
      expected AS (SELECT used AS n FROM used)
      SELECT rec_id, is_anomaly, round(pow(2, -mean_path / ({path})), 6) AS score FROM metrics JOIN ends USING (rec_id), expected"""


def _inverse(case: dict, column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in case.items()) + " ELSE 'UNKNOWN' END"


def _log_rules() -> str:
    parts = " ".join(
        f"WHEN log_type = '{kind}'" + (f" AND contains(message, '{text}')" if text else "") + f" THEN '{outcome}'"
        for kind, text, outcome in LOG_RULES
    )
    return f"""SELECT page_id, log_type, CASE {parts} END AS anomaly_type FROM (
      SELECT page_id, html AS message, CASE page_id % 3 WHEN 0 THEN 'syslog' WHEN 1 THEN 'auth' ELSE 'apache' END AS log_type
      FROM pages)"""


def _r(columns, places: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {places}) AS {c}" for c in columns)


def _external() -> str:
    cols = network_columns("o", "b", "p", "s", "0")
    cols["payload_density"] = "least(smean / (s + 0.01), 1e5)"
    cols |= {"is_common_port": "0", "is_suspicious_port": "0", "bytes_out": "o", "bytes_in": "b", "packets": "p",
             "duration_ms": "s * 1000", "src_port": "0", "dst_port": "0"}
    return with_ctes(C_FLOWS, "SELECT flow_id, " + ", ".join(
        f"round(CAST({cols[c]} AS DOUBLE), 6) AS {c}" for c in FLOW_FEATURES
    ) + f""" FROM (SELECT flow_id, bytes_out AS o, bytes_in AS b, packets AS p, {_SECONDS} AS s,
         (bytes_out + bytes_in) / (packets + 1) AS smean FROM flows)""")


def _histogram() -> str:
    return with_ctes(C_METRICS + [
        ("r", "SELECT is_anomaly AS k, min(mem_percent) AS lo, max(mem_percent) AS hi FROM metrics GROUP BY is_anomaly"),
        ("w", "SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 30 ELSE 1.0 END AS width FROM r"),
        ("b", """SELECT is_anomaly, CAST(least(floor((mem_percent - lo) / width), 29) AS BIGINT) AS bin, lo, width
                 FROM metrics JOIN w ON is_anomaly = k"""),
    ], "SELECT is_anomaly, bin, round(lo + bin * width, 6) AS bin_start, count(*) AS n FROM b GROUP BY ALL")


def _grid() -> str:
    return with_ctes(C_METRIC_SCORED + [
        ("rg", "SELECT min(score) AS lo, max(score) AS hi, sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS total FROM mscored"),
        ("grid", """SELECT CAST(i AS INTEGER) AS slot, CASE WHEN i = 199 THEN hi ELSE i * ((hi - lo) / 199) + lo END AS threshold, total
                    FROM rg, range(200) AS t(i)"""),
        ("hits", """SELECT slot, threshold, total, sum(CASE WHEN score >= threshold AND is_anomaly THEN 1 ELSE 0 END) AS tp,
                    sum(CASE WHEN score >= threshold AND NOT is_anomaly THEN 1 ELSE 0 END) AS fp FROM grid, mscored GROUP BY ALL"""),
        ("f", "SELECT *, CASE WHEN tp + fp + total > 0 THEN 2 * tp / (tp + fp + total) ELSE 0.0 END AS f1 FROM hits"),
    ], """SELECT round(CASE WHEN f1 > 0 THEN threshold ELSE 0.0 END, 6) AS threshold, round(f1, 6) AS f1
          FROM f ORDER BY f1 DESC, slot LIMIT 1""")


def _two() -> list[tuple[str, str]]:
    raw = FLOW_FEATURES[:6]
    return C_FLOWS + [
        ("fstats", stats_cte("feats", FLOW_FEATURES)),
        ("both_", f"SELECT feats.*, {zscore(raw)} AS before_score, {zscore(FLOW_FEATURES)} AS after_score FROM feats, fstats"),
        ("lim", """SELECT quantile_cont(before_score, 0.92) AS tb, quantile_cont(after_score, 0.92) AS ta
                   FROM both_ WHERE NOT is_anomaly"""),
        ("missed", "SELECT *, CASE WHEN after_score >= ta THEN 'recovered' ELSE 'still_missed' END AS outcome "
                   "FROM both_, lim WHERE is_anomaly AND before_score < tb"),
    ]


def _drift() -> str:
    def phase(name: str, where: str, n: str) -> list[tuple[str, str]]:
        pts = dict(points_ctes(f"sc{n}", "score", "is_anomaly"))
        return [
            (f"st{n}", stats_cte("feats", FLOW_FEATURES, where)),
            (f"all{n}", f"SELECT feats.*, {zscore(FLOW_FEATURES)} AS score FROM feats, st{n}"),
            (f"lim{n}", f"SELECT quantile_cont(score, 0.92) AS t FROM all{n} WHERE {where}"),
            (f"sc{n}", f"SELECT * FROM all{n} WHERE flow_id % 2 = 1"),
            (f"counts{n}", pts["counts"]),
            (f"points{n}", pts["points"].replace("FROM counts", f"FROM counts{n}")),
            (f"ev{n}", evaluation(f"(SELECT t FROM lim{n})").replace("FROM points", f"FROM points{n}")),
        ]

    return with_ctes(
        C_FLOWS + phase("before", "NOT is_anomaly AND flow_id % 2 = 0", "1") + phase("after", "NOT is_anomaly", "2"),
        "SELECT *, 'before' AS phase FROM ev1 UNION ALL SELECT *, 'after' AS phase FROM ev2",
    )


def _long(names: dict[str, str], source: str, key: str) -> tuple[str, str]:
    return ("long", " UNION ALL ".join(
        f"SELECT '{shown}' AS {key}, {column} AS score, is_anomaly FROM {source}" for shown, column in names.items()
    ))


def _clients() -> str:
    return """SELECT CAST(extract(DAY FROM ts) AS INTEGER) AS round, CAST(floor(rec_id / 1000) % 3 AS INTEGER) AS client,
      count(*) AS n_examples, avg(mem_percent) / 100 AS loss, avg(CASE WHEN is_anomaly THEN 1.0 ELSE 0.0 END) AS roc_auc,
      avg(cpu_percent) AS f1 FROM metrics GROUP BY ALL"""


C_ROUNDS = C_METRICS + [
    ("res", _clients()),
    ("rounds", """SELECT round, count(*) AS n_clients, avg(loss) AS avg_loss, CAST(sum(n_examples) AS BIGINT) AS total_examples,
       sum(loss * n_examples) / sum(n_examples) AS weighted_loss, sum(roc_auc * n_examples) / sum(n_examples) AS weighted_roc_auc,
       sum(f1 * n_examples) / sum(n_examples) AS weighted_f1 FROM res GROUP BY round"""),
]


def _fedavg() -> str:
    layers = [METRIC_FEATURES[:5], METRIC_FEATURES[5:]]
    lines = [
        f"SELECT {i} AS layer, {j} AS pos, round(sum(n * {c}) / sum(n), 6) AS value FROM cm"
        for i, part in enumerate(layers) for j, c in enumerate(part)
    ]
    return with_ctes(C_METRICS + [("cm", "SELECT CAST(floor(rec_id / 1000) % 3 AS INTEGER) AS client, count(*) AS n, " + ", ".join(
        f"avg({c}) AS {c}" for c in METRIC_FEATURES) + " FROM metrics GROUP BY 1")], " UNION ALL ".join(lines))


def _correlations() -> str:
    lines = [
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM metrics"
        for i, a in enumerate(METRIC_FEATURES) for b in METRIC_FEATURES[i:]
    ]
    return with_ctes(C_METRICS, " UNION ALL ".join(lines))


def _class_means() -> str:
    lines = [
        f"SELECT '{c}' AS feature, round(avg(CASE WHEN NOT is_anomaly THEN {c} END), 6) AS normal_mean, "
        f"round(avg(CASE WHEN is_anomaly THEN {c} END), 6) AS anomaly_mean FROM metrics"
        for c in METRIC_FEATURES
    ]
    return with_ctes(C_METRICS, " UNION ALL ".join(lines))


def _heuristic() -> str:
    lines = [f"SELECT rec_id, '{c}' AS feature, {i} AS pos, abs({c}) AS value FROM metrics WHERE is_anomaly"
             for i, c in enumerate(METRIC_FEATURES)]
    return with_ctes(C_METRICS + [
        ("v", " UNION ALL ".join(lines)),
        ("p", "SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY value DESC, pos) AS place FROM v"),
    ], "SELECT rec_id, string_agg(feature, ',' ORDER BY place) AS top_features FROM p WHERE place <= 3 GROUP BY rec_id")


def _narratives() -> str:
    known = "mitre_technique_id || ' ' || mitre_technique || ' < ' || mitre_tactic_id || ' ' || mitre_tactic"
    rest = f"{known} || ' | ' || description || ' | next: ' || recommended_action"
    return with_ctes(C_METRIC_ALERTS, f"""
      SELECT id, 'metric ' || anomaly_type || ' | severity ' || severity || ', score # | ' || {rest} AS text FROM malerts
      UNION ALL
      SELECT CAST(rec_id AS STRING), strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || host || ' | severity ' || a.severity
        || ', score # | driven by ' || replace(tops, ',', '=#, ') || '=# | ' || {rest}
      FROM mtop JOIN malerts a ON a.id = md5('metric|' || CAST(rec_id AS STRING))""")


def _explanations() -> str:
    value = "CASE feature " + " ".join(f"WHEN '{c}' THEN CAST(mtop.{c} AS DOUBLE)" for c in METRIC_FEATURES) + " END"
    return with_ctes(C_METRIC_ALERTS, f"""SELECT mtop.rec_id, a.source, a.anomaly_type, a.fused_score, a.severity,
        CASE a.severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END AS severity_rank,
        a.mitre_tactic, a.mitre_technique_id, tops AS top_features, round({value}, 6) AS top_value
      FROM mtop JOIN malerts a ON a.id = md5('metric|' || CAST(mtop.rec_id AS STRING))
      JOIN ranked ON ranked.rec_id = mtop.rec_id AND place = 0""")


def _pca_fixed() -> str:
    d = len(METRIC_FEATURES)
    mean = "(" + " + ".join(z(c) for c in METRIC_FEATURES) + f") / {d}"
    error = " + ".join(f"pow({z(c)} - {mean}, 2)" for c in METRIC_FEATURES)
    return with_ctes(C_METRICS + [("mstats", stats_cte("metrics", METRIC_FEATURES))],
                     f"SELECT rec_id, round(({error}) / {d}, 6) AS score FROM metrics, mstats")


def oracle_sql() -> dict[str, str]:
    net_rounded = [c for c in DERIVED_FLOW_FEATURES if not c.startswith("is_")]
    net_flags = [c for c in DERIVED_FLOW_FEATURES if c.startswith("is_")]
    error_points = [("e", "SELECT value, event_type = 'error' AS is_error FROM events")] + points_ctes("e", "value", "is_error")
    flow_points = C_FLOW_SCORED + points_ctes("fscored", "score", "is_anomaly")
    metric_points = C_METRIC_SCORED + points_ctes("mscored", "score", "is_anomaly")
    clip_ctes = C_METRIC_SCORED + [
        ("cl", "SELECT 2 * quantile_cont(score, 0.99) AS c FROM mscored WHERE NOT is_anomaly"),
        ("clipped", "SELECT is_anomaly, greatest(least(score, c), 0.0) AS score FROM mscored, cl"),
    ] + points_ctes("clipped", "score", "is_anomaly")
    paired = [
        ("a", "SELECT rec_id, score AS ae_score, row_number() OVER (ORDER BY rec_id) - 1 AS row_index FROM mscored"),
        ("b", "SELECT log_id, score AS bert_score, row_number() OVER (ORDER BY log_id) - 1 AS row_index FROM lscored"),
        ("paired", "SELECT row_index, rec_id, ae_score, log_id, bert_score FROM a JOIN b USING (row_index)"),
    ]
    net_sql = network_columns("bytes_out", "bytes_in", "packets", "seconds", "dst_port")
    return {
        "network_features": with_ctes(C_FLOWS, f"SELECT flow_id, {_r(net_rounded)}, {', '.join(net_flags)} FROM feats"),
        "external_flow_features": _external(),
        "selected_features": with_ctes(C_FLOWS, """SELECT flow_id, CAST(bytes_out AS DOUBLE) AS bytes_out,
            CAST(coalesce(duration_ms, 0) AS DOUBLE) AS duration_ms FROM flows"""),
        "standardized_features": with_ctes(
            C_METRICS + [("mstats", stats_cte("metrics", METRIC_FEATURES))],
            "SELECT rec_id, " + ", ".join(f"round({z(c)}, 6) AS {c}" for c in METRIC_FEATURES) + " FROM metrics, mstats"),
        "service_lookup": with_ctes(C_FLOWS, f"SELECT flow_id, dst_port, {_inverse(SERVICE_BY_PORT, 'dst_port')} AS service FROM flows"),
        "log_rules": _log_rules(),
        "message_lengths": "SELECT doc_id AS log_id, CAST(length(text) AS INTEGER) AS message_length FROM documents",
        "record_origins": with_ctes(C_FLOWS + C_METRICS + C_LOGS, """
            SELECT 'network' AS modality, flow_id AS key, src_ip AS origin, coalesce(CAST(is_anomaly AS INTEGER), -1) AS label FROM flows
            UNION ALL SELECT 'metric', rec_id, host, coalesce(CAST(is_anomaly AS INTEGER), -1) FROM metrics
            UNION ALL SELECT 'log', log_id, source, coalesce(CAST(is_anomaly AS INTEGER), -1) FROM logs"""),
        "class_ranges": with_ctes(C_METRIC_SCORED + [("r", """SELECT
            min(CASE WHEN NOT is_anomaly THEN score END) AS normal_min, max(CASE WHEN NOT is_anomaly THEN score END) AS normal_max,
            min(CASE WHEN is_anomaly THEN score END) AS anomaly_min, max(CASE WHEN is_anomaly THEN score END) AS anomaly_max
            FROM mscored""")], f"""SELECT {_r(['normal_min', 'normal_max', 'anomaly_min', 'anomaly_max'])},
            normal_max >= anomaly_min AND anomaly_max >= normal_min AS overlap FROM r"""),
        "class_means": _class_means(),
        "feature_histogram": _histogram(),
        "correlation_matrix": _correlations(),
        "dataset_summary": with_ctes(C_FLOWS + C_METRICS + C_LOGS + [
            ("u", """SELECT 'network' AS modality, is_anomaly FROM flows UNION ALL SELECT 'metric', is_anomaly FROM metrics
                     UNION ALL SELECT 'log', is_anomaly FROM logs"""),
            ("s", """SELECT coalesce(modality, 'total') AS modality, count(*) AS n,
                     CAST(sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS BIGINT) AS anomalies FROM u GROUP BY ROLLUP (modality)"""),
        ], "SELECT *, round(CAST(100 AS DOUBLE) * anomalies / n, 2) AS rate_pct FROM s"),
        "value_counts_service": with_ctes(C_FLOWS, f"""SELECT service, n, round(n / sum(n) OVER (), 6) AS share FROM (
            SELECT {_inverse(SERVICE_BY_PORT, 'dst_port')} AS service, count(*) AS n FROM flows GROUP BY 1)"""),
        "top_ports": with_ctes(C_FLOWS, "SELECT dst_port, count(*) AS n FROM flows GROUP BY 1 ORDER BY n DESC, dst_port LIMIT 10"),
        # What must hold for learned results, whatever was learned.
        "boosted_importance_total": f"SELECT CAST({len(FLOW_FEATURES)} AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS negative",
        "tree_attribution_sums": with_ctes(C_FLOWS, f"""SELECT flow_id, CAST({len(FLOW_FEATURES)} AS BIGINT) AS features, CAST(0 AS DOUBLE) AS gap
          FROM flows WHERE is_anomaly"""),
        "iforest_scores": _forest(),
        "forest_attribution_sums": with_ctes(C_METRICS, "SELECT rec_id, CAST(0 AS DOUBLE) AS gap FROM metrics WHERE is_anomaly"),
        "term_attribution_sums": "SELECT doc_id AS log_id, CAST(0 AS DOUBLE) AS gap FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "shapley_sums": with_ctes(C_METRICS, "SELECT rec_id, CAST(0 AS DOUBLE) AS gap FROM metrics WHERE is_anomaly"),
        "pca_keeps_lengths": with_ctes(C_METRIC_SCORED, f"""SELECT rec_id, round({len(METRIC_FEATURES)} * score, 5) AS squared_length,
          CAST(0 AS DOUBLE) AS error FROM mscored"""),
        "zscore_scores": with_ctes(C_THREE, f"SELECT rec_id, {_r(_THREE)} FROM three"),
        "score_percentiles": with_ctes(C_METRIC_SCORED, " UNION ALL ".join(
            f"SELECT CAST({p} AS DOUBLE) AS fraction, round(quantile_cont(score, {p}), 6) AS value FROM mscored" for p in PERCENTILES)),
        "score_stats": with_ctes(C_METRIC_SCORED, """SELECT count(*) AS n, round(min(score), 6) AS min, round(max(score), 6) AS max,
            round(avg(score), 6) AS mean, round(avg(CAST(prediction AS DOUBLE)), 6) AS share_above FROM mpred"""),
        "bounds_normalized": with_ctes(C_METRIC_SCORED + [
            ("bd", "SELECT min(score) AS lo, max(score) AS hi FROM mscored WHERE NOT is_anomaly")],
            "SELECT rec_id, round(greatest(least((score - lo) / (hi - lo + 1e-8), 1.0), 0.0), 6) AS normalized FROM mscored, bd"),
        "minmax_normalized": with_ctes(C_METRIC_SCORED + [("bd", "SELECT min(score) AS lo, max(score) AS hi FROM mscored")],
            "SELECT rec_id, round((score - lo) / (hi - lo), 6) AS score FROM mscored, bd"),
        "fuse_weighted": _fuse("weighted_avg"),
        "fuse_max": _fuse("max"),
        "fuse_vote": _fuse("vote"),
        "fuse_supervised": with_ctes(C_THREE, f"""SELECT rec_id, round({_clip(_SUPERVISED, 0, 1)}, 6) AS fused_score FROM (
            SELECT rec_id, bert_score AS sup, ae_score AS rec, t_ae_score AS t_rec FROM three, limits)"""),
        "fuse_ratio": with_ctes(C_THREE, f"""SELECT rec_id, round({_clip(_RATIO, 0, 1)}, 6) AS fused_score FROM (
            SELECT rec_id, if_score AS iso, ae_score AS rec, t_ae_score AS t_rec, t_if_score AS t_iso FROM three, limits)"""),
        "fuse_routed": with_ctes(C_THREE, f"""SELECT rec_id,
            round(coalesce({_clip(_SUPERVISED, 0, 1)}, {_clip(_RATIO, 0, 1)}, iso, 0.0), 6) AS fused_score FROM (
            SELECT rec_id, CASE WHEN rec_id % 4 = 0 THEN bert_score END AS sup, CASE WHEN rec_id % 4 < 2 THEN ae_score END AS rec,
              CASE WHEN rec_id % 4 < 3 THEN if_score END AS iso, t_ae_score AS t_rec, t_if_score AS t_iso FROM three, limits)"""),
        "fuse_joined": with_ctes(C_THREE + [
            ("joined", """SELECT rec_id, CASE WHEN rec_id % 2 = 0 THEN if_score END AS if_score,
                CASE WHEN rec_id % 3 = 0 THEN ae_score END AS ae_score, bert_score FROM three
                WHERE rec_id % 2 = 0 OR rec_id % 3 = 0 OR bert_score IS NOT NULL"""),
        ] + scaled_ctes("joined"), f"""SELECT rec_id, round(f, 6) AS fused_score, CASE WHEN f >= 0.5 THEN 1 ELSE 0 END AS is_anomaly_pred
            FROM (SELECT rec_id, {_FUSED['weighted_avg']} AS f FROM scaled)"""),
        "fuse_positional": with_ctes(C_METRIC_SCORED + C_LOG_SCORED + paired + scaled_ctes("paired", ("ae_score", "bert_score")),
            f"SELECT row_index, rec_id, log_id, round({weighted_sql(('ae_score', 'bert_score'))}, 6) AS fused_score FROM scaled"),
        "compare_strategies": with_ctes(C_THREE + scaled_ctes() + [
            ("wide", "SELECT is_anomaly, " + ", ".join(f"{sql} AS {s}" for s, sql in (
                ("weighted_avg", _FUSED["weighted_avg"]), ("max_", _FUSED["max"]), ("vote", _FUSED["vote"]))) + " FROM scaled"),
            _long({"weighted_avg": "weighted_avg", "max": "max_", "vote": "vote"}, "wide", "strategy"),
        ] + points_ctes("long", "score", "is_anomaly", "strategy"),
            f"SELECT strategy, roc_auc, f1 FROM ({evaluation('0.5', 'strategy')})"),
        "compare_detectors": with_ctes(C_THREE + [_long({c: c for c in _THREE}, "three", "detector")]
            + points_ctes("long", "score", "is_anomaly", "detector"),
            evaluation("(CASE detector " + " ".join(f"WHEN '{c}' THEN (SELECT t_{c} FROM limits)" for c in _THREE) + " END)", "detector")),
        "pr_curve": with_ctes(error_points, """SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision,
            round(tp / n_pos, 6) AS recall FROM points UNION ALL SELECT NULL, 1.0, 0.0"""),
        "roc_curve": with_ctes(error_points, """SELECT score AS threshold, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr
            FROM points"""),
        "roc_auc": with_ctes(metric_points, f"SELECT round({_AUC}, 6) AS roc_auc FROM points"),
        "average_precision": with_ctes(error_points, f"SELECT round({_AUC}, 6) AS roc_auc, round({_AP}, 6) AS avg_precision FROM points"),
        "threshold_f1": with_ctes(flow_points, f"SELECT {_r(['threshold', 'f1', 'recall'])} FROM ({best_f1(0.9)})"),
        "threshold_percentile": with_ctes(C_FLOW_SCORED, "SELECT round(t, 6) AS threshold, count(*) AS n FROM fpred GROUP BY t"),
        "threshold_clipped": with_ctes(clip_ctes, f"""SELECT {_r(['threshold', 'f1', 'recall'])}, round(c, 6) AS score_clip
            FROM ({best_f1(0.9)}), cl"""),
        "threshold_grid": _grid(),
        "threshold_recall": with_ctes(flow_points, "SELECT round(max(score), 6) AS threshold FROM points WHERE tp / n_pos >= 0.95"),
        "calibrated_config": with_ctes(C_FLOW_SCORED + C_METRIC_SCORED + [
            ("long", """SELECT 'network' AS modality, score, is_anomaly FROM fscored
                        UNION ALL SELECT 'metric', score, is_anomaly FROM mscored"""),
        ] + points_ctes("long", "score", "is_anomaly", "modality") + [
            ("bm", best_f1(0.0, "modality")), ("bn", best_f1(0.9, "modality")),
            ("th", "SELECT modality, threshold FROM bm WHERE modality = 'metric' UNION ALL "
                   "SELECT modality, threshold FROM bn WHERE modality = 'network'"),
        ], "SELECT modality, count(*) AS n, round(any_value(threshold), 6) AS threshold FROM long JOIN th USING (modality) GROUP BY modality"),
        "confusion": with_ctes(C_FLOW_SCORED + [("c", _CONFUSION), (
            "q", "SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM c")],
            """SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(2 * precision * recall / greatest(precision + recall, 1e-8), 6) AS f1 FROM q"""),
        "classification_report": _report(),
        "evaluation_row": with_ctes(flow_points, evaluation("(SELECT t FROM flimit)")),
        "errors_listing": with_ctes(C_FLOW_SCORED, """SELECT flow_id, anomaly_type, round(score, 6) AS score,
            CASE WHEN is_anomaly THEN 'missed' ELSE 'false alarm' END AS kind FROM fpred
            WHERE (is_anomaly AND prediction = 0) OR (NOT is_anomaly AND prediction = 1)"""),
        "missed_summary": with_ctes(C_FLOW_SCORED, """SELECT anomaly_type, count(*) AS n, round(avg(score), 6) AS mean_score
            FROM fpred WHERE is_anomaly AND prediction = 0 GROUP BY anomaly_type"""),
        "recall_by_type": with_ctes(C_FLOW_SCORED, """SELECT anomaly_type, round(avg(CAST(prediction AS DOUBLE)), 6) AS recall, count(*) AS n
            FROM fpred WHERE anomaly_type IS NOT NULL GROUP BY anomaly_type"""),
        "recovery_report": with_ctes(_two(), f"SELECT flow_id, anomaly_type, outcome, {_r(['before_score', 'after_score'])} FROM missed"),
        "recovered_sets": with_ctes(_two(), "SELECT flow_id, outcome FROM missed"),
        "verdict": with_ctes(flow_points + [("ev", evaluation("(SELECT t FROM flimit)"))], """SELECT roc_auc, recall,
            CASE WHEN roc_auc >= 0.95 AND 1 - recall < 0.15 THEN 'holds' WHEN roc_auc >= 0.85 THEN 'reasonable' ELSE 'gap' END AS verdict
            FROM ev"""),
        "drift_compare": _drift(),
        "alerts_flows": with_ctes(C_FLOW_ALERTS, "SELECT * FROM falerts"),
        "alerts_all": with_ctes(C_ALL_ALERTS, "SELECT * FROM alerts"),
        "latest_alerts": with_ctes(C_FLOW_ALERTS, """SELECT id, timestamp, source, anomaly_type, fused_score, severity FROM falerts
            WHERE severity = 'critical' ORDER BY timestamp DESC, id DESC LIMIT 100"""),
        "alert_detail": with_ctes(C_FLOW_ALERTS + [
            ("n", "SELECT *, row_number() OVER (PARTITION BY severity ORDER BY timestamp DESC, id DESC) AS place FROM falerts")],
            """SELECT id, timestamp, n.source, n.anomaly_type, fused_score, severity, mitre_tactic, mitre_technique, top_features,
               f.dst_ip, f.bytes_out AS raw_bytes_out FROM n JOIN fpred f ON id = md5('network|' || CAST(flow_id AS STRING))
               WHERE place = 1"""),
        "count_by_severity": with_ctes(C_FLOW_ALERTS, f"""SELECT s.severity, count(a.id) AS n FROM {_SEVERITY_ROWS}
            LEFT JOIN falerts a ON a.severity = s.severity GROUP BY s.severity"""),
        "recent_severity": with_ctes(C_METRIC_ALERTS, f"""SELECT s.severity, count(a.id) AS n FROM {_SEVERITY_ROWS}
            LEFT JOIN (SELECT * FROM malerts ORDER BY timestamp DESC, id DESC LIMIT 100) a ON a.severity = s.severity GROUP BY s.severity"""),
        "count_by_tactic": with_ctes(C_ALL_ALERTS, "SELECT mitre_tactic AS tactic, count(*) AS n FROM alerts GROUP BY 1"),
        "acked_alerts": with_ctes(C_FLOW_ALERTS + [ACKS, ("last", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id
            ORDER BY acknowledged_at DESC, acknowledged_by DESC, note DESC NULLS LAST) AS place FROM acks) WHERE place = 1""")],
            """SELECT id, alert_id IS NOT NULL AS is_acknowledged, acknowledged_by, note, acknowledged_at
               FROM falerts LEFT JOIN last ON id = alert_id"""),
        "unacked_alerts": with_ctes(C_FLOW_ALERTS + [ACKS],
            "SELECT id, severity FROM falerts WHERE NOT EXISTS (SELECT 1 FROM acks WHERE alert_id = id)"),
        "orphan_acks": with_ctes(C_FLOW_ALERTS + [ACKS],
            "SELECT * FROM acks WHERE NOT EXISTS (SELECT 1 FROM falerts WHERE alert_id = id)"),
        "deduped_alerts": with_ctes(C_METRIC_ALERTS, """SELECT id, CASE WHEN again THEN timestamp + INTERVAL 1 DAY ELSE timestamp END AS timestamp,
            source, CASE WHEN again THEN 'low' ELSE severity END AS severity
            FROM (SELECT *, CAST('0x' || substr(id, 1, 1) AS INTEGER) % 3 = 0 AS again FROM malerts)"""),
        "dashboard_stats": with_ctes(C_FLOW_SCORED + [KB, ("last", """SELECT prediction, kb_severity FROM fpred LEFT JOIN kb
            ON anomaly_type = kb_anomaly_type ORDER BY ts DESC, flow_id DESC LIMIT 200"""), ("s", """SELECT count(*) AS total,
            CAST(sum(prediction) AS BIGINT) AS anomalies,
            CAST(sum(CASE WHEN prediction = 1 AND kb_severity = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical FROM last""")],
            "SELECT *, round(CAST(100 AS DOUBLE) * anomalies / total, 1) AS rate_pct FROM s"),
        "feed_view": with_ctes(C_LOG_SCORED, """SELECT log_id, CASE WHEN raised THEN 'alert' ELSE 'record' END AS type, source AS origin,
            CASE WHEN raised THEN replace(coalesce(anomaly_type, 'unknown'), '_', ' ')
                 WHEN length(message) > 0 THEN substr(message, 1, 60) ELSE 'normal activity' END AS title FROM lpred"""),
        "waveform": with_ctes(C_METRIC_SCORED, """SELECT ts, rec_id, round(CASE WHEN prediction = 1 THEN score ELSE 0.08 END, 6) AS value
            FROM mpred ORDER BY ts DESC, rec_id DESC LIMIT 80"""),
        "stream_stats": with_ctes(C_METRIC_SCORED + [("s", """SELECT count(*) AS n, CAST(sum(prediction) AS BIGINT) AS a, min(ts) AS first,
            max(ts) AS last FROM mpred""")], """SELECT n AS total_records_processed, a AS total_anomalies_detected,
            round(a / greatest(n, 1), 4) AS anomaly_rate, round(n / greatest(epoch(last) - epoch(first), 1.0), 2) AS records_per_second,
            first AS active_since FROM s"""),
        "windowed_stats": with_ctes(C_METRIC_SCORED + C_LOG_SCORED + [("u", """SELECT ts, 'metric' AS modality, prediction AS a FROM mpred
            UNION ALL SELECT ts, 'log', CAST(raised AS INTEGER) FROM lpred"""), ("w", """SELECT date_trunc('hour', ts) AS window_start,
            modality, count(*) AS n, CAST(sum(coalesce(a, 0)) AS BIGINT) AS anomalies FROM u GROUP BY ALL""")],
            """SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, modality, n, anomalies,
               round(anomalies / n, 4) AS anomaly_rate, round(n / CAST(3600 AS DOUBLE), 6) AS records_per_second FROM w"""),
        "tactics_catalog": with_ctes(C_FLOWS + C_METRICS + C_LOGS + [KB, ("u", """SELECT anomaly_type FROM flows WHERE is_anomaly
            UNION SELECT anomaly_type FROM metrics WHERE is_anomaly UNION SELECT anomaly_type FROM logs WHERE is_anomaly""")],
            f"SELECT DISTINCT {_kb('tactic')} AS tactic FROM u LEFT JOIN kb ON anomaly_type = kb_anomaly_type"),
        "attribution": with_ctes(C_ATTRIBUTION, "SELECT rec_id, CAST(place AS INTEGER) AS place, feature, value FROM ranked"),
        "attribution_bars": with_ctes(C_ATTRIBUTION + [
            ("nz", """SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY place) AS k,
                      max(abs(value)) OVER (PARTITION BY rec_id) AS top FROM ranked WHERE value <> 0""")],
            "SELECT rec_id, feature, value, round(abs(value) / top * 100, 4) AS pct FROM nz WHERE k <= 8"),
        "global_importance": with_ctes(C_ATTRIBUTION, "SELECT feature, round(avg(abs(value)), 6) AS importance FROM ranked GROUP BY feature"),
        "explanations": _explanations(),
        "narratives": _narratives(),
        "most_anomalous": with_ctes(C_METRIC_SCORED, """SELECT rec_id, host, round(score, 6) AS score FROM mscored WHERE is_anomaly
            ORDER BY mscored.score DESC, rec_id LIMIT 1"""),
        "top_raw_features": _heuristic(),
        "stratified_split": with_ctes(C_METRICS + [
            ("h", f"SELECT rec_id, is_anomaly, {_uniform('rec_id', 42)} AS u FROM metrics"),
            ("c", "SELECT is_anomaly, quantile_cont(u, 0.2) AS a, quantile_cont(u, 0.2 + 0.1) AS b FROM h GROUP BY is_anomaly")],
            "SELECT rec_id, CASE WHEN u < a THEN 'test' WHEN u < b THEN 'validation' ELSE 'train' END AS split FROM h JOIN c USING (is_anomaly)"),
        "row_index": with_ctes(C_METRICS, "SELECT ts, rec_id, row_number() OVER (ORDER BY ts, rec_id) - 1 AS row_index FROM metrics"),
        "client_partitions": with_ctes(C_METRICS + [
            ("i", "SELECT rec_id, row_number() OVER (ORDER BY ts, rec_id) - 1 AS i, count(*) OVER () // 3 AS size FROM metrics")],
            "SELECT rec_id, CAST(least(i // size, 2) AS INTEGER) AS client FROM i"),
        "background_sample": with_ctes(C_METRICS, f"""SELECT rec_id, open_connections FROM metrics WHERE NOT is_anomaly
            ORDER BY {_uniform('rec_id', 42)}, rec_id LIMIT 200"""),
        "sampled_rows": with_ctes(C_FLOWS, f"SELECT flow_id, dst_port FROM flows ORDER BY {_uniform('flow_id', 7)}, flow_id LIMIT 50"),
        "sampled_messages": with_ctes(C_LOGS + [("r", f"""SELECT *, row_number() OVER (PARTITION BY is_anomaly
            ORDER BY {_uniform('log_id', 42)}, log_id) AS k FROM logs WHERE is_anomaly IS NOT NULL""")],
            "SELECT log_id, is_anomaly, substr(message, 1, 80) AS message FROM r WHERE k <= 5"),
        "class_weights": with_ctes(C_METRICS + [("c", """SELECT CAST(sum(CASE WHEN is_anomaly THEN 0 ELSE 1 END) AS BIGINT) AS n_normal,
            CAST(sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS BIGINT) AS n_anomaly FROM metrics""")],
            """SELECT n_normal, n_anomaly, CAST(1 AS DOUBLE) AS normal_weight, round(n_normal / greatest(n_anomaly, 1), 2) AS anomaly_weight
               FROM c"""),
        "fedavg": _fedavg(),
        "round_metrics": with_ctes(C_ROUNDS, f"""SELECT round, n_clients, total_examples,
            {_r(['avg_loss', 'weighted_loss', 'weighted_roc_auc', 'weighted_f1'])} FROM rounds"""),
        "federated_status": with_ctes(C_ROUNDS + [("last", "SELECT * FROM rounds ORDER BY round DESC LIMIT 1")],
            """SELECT round AS current_round, 5 AS total_rounds, CAST(i AS INTEGER) AS node_id, round AS last_round,
               round(avg_loss, 6) AS last_loss, CAST(total_examples // greatest(n_clients, 1) AS BIGINT) AS n_samples
               FROM last, range(100) AS t(i) WHERE i < n_clients"""),
        "sql_functions": with_ctes(C_FLOWS + [("s", f"SELECT *, {_SECONDS} AS seconds FROM flows")], "SELECT flow_id, " + ", ".join(
            (f"{net_sql[c]} AS {c}" if c.startswith("is_") else f"round({net_sql[c]}, 6) AS {c}")
            for c in DERIVED_FLOW_FEATURES if c != "bytes_per_packet") + f""",
            round(0.7 * greatest(least({net_sql['byte_asymmetry']}, 1.0), 0.0) + 0.3 * greatest(least(seconds / 0.5, 3.0), 0.0) / 3, 6)
              AS supervised FROM s"""),
        "pca_fixed": _pca_fixed(),
        "custom_scorer": with_ctes(C_METRICS, """SELECT rec_id, round((cpu_percent + mem_percent) / (open_connections + 1), 6) AS score
            FROM metrics"""),
    }
