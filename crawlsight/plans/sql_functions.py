"""The library's expressions and questions as Spark SQL functions, for users who write SQL alone.

`register` creates temporary functions. Expressions take columns; reports are table functions over the
view `bot_events`, with their limits and bucket widths as arguments:

    SELECT client_subnet(ip), count(*) FROM bot_events GROUP BY 1;
    SELECT * FROM report_top_paths(20);
    SELECT * FROM report_timeseries(300);

Spark inlines both, so a report's plan is that of a query written out. A top list keeps its limit in
every task.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.network import SESSION_BUCKET_SECONDS
from ..functions.useragent import BROWSER_TOKENS, KNOWN_BOT_TOKENS
from ..functions.verdicts import HEURISTIC_RISK
from ..operators.rollups import NO_PATH


def _mentions(tokens: tuple[str, ...]) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower(ua), '{t}')" for t in tokens) + ", false)"


_BOTS, _HUMANS = "count_if(is_bot = 1)", "count_if(is_bot = 0)"
_HALF = 0.5 * 10.0 ** -4


def _top(question: str, columns: str, order: str) -> str:
    """The first `max_rows` of a question; Spark turns this form into a limit per task."""
    return (f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ({question})) "
            "WHERE place <= max_rows")


# name, arguments, result, SQL; later ones may call earlier ones
EXPRESSIONS = [
    ("is_known_bot", "ua STRING", "BOOLEAN", _mentions(KNOWN_BOT_TOKENS)),
    ("is_browser", "ua STRING", "BOOLEAN", f"{_mentions(BROWSER_TOKENS)} AND NOT is_known_bot(ua)"),
    ("char_entropy", "text STRING", "DOUBLE",
     "CASE WHEN length(text) > 0 THEN aggregate(transform(array_distinct(split(text, '')), "
     "c -> (length(text) - length(replace(text, c, ''))) / length(text)), 0D, (bits, p) -> bits - p * log2(p)) ELSE 0D END"),
    ("client_subnet", "ip STRING", "STRING",
     r"coalesce(nullif(regexp_extract(ip, r'^(\d+\.\d+\.\d+)(?:\.|$)', 1), '') || '.0/24', '')"),
    ("rate_limit_key", "ip STRING", "STRING", "coalesce(nullif(client_subnet(ip), ''), ip)"),
    ("client_session", "ip STRING, at DOUBLE", "STRING",
     f"md5(CAST(ip || CAST(floor(at / {SESSION_BUCKET_SECONDS}D) AS BIGINT) AS BINARY))"),
    ("time_bucket", "at DOUBLE, seconds INT", "BIGINT", "CAST(floor(at / CAST(seconds AS DOUBLE)) AS BIGINT) * seconds"),
    ("share_of", "part BIGINT, whole BIGINT", "DOUBLE",
     f"CASE WHEN coalesce(whole, 0) = 0 THEN 0D WHEN CAST(part AS DOUBLE) / whole = {_HALF!r}D THEN {round(_HALF, 4)!r}D "
     "ELSE CAST(replace(format_number(CAST(part AS DOUBLE) / whole, 4), ',', '') AS DOUBLE) END"),
    ("heuristic_risk", "known_bot INT, rate_404 DOUBLE", "DOUBLE",
     f"CASE WHEN coalesce(known_bot, 0) <> 0 OR coalesce(rate_404, 0D) > 0.5D THEN {HEURISTIC_RISK[0]}D ELSE {HEURISTIC_RISK[1]}D END"),
    ("threat_tier", "risk DOUBLE, is_bot BOOLEAN", "STRING",
     "CASE WHEN is_bot OR risk > 0.7D THEN 'CRITICAL' WHEN risk > 0.4D THEN 'HIGH' WHEN risk > 0.2D THEN 'MEDIUM' ELSE 'SAFE' END"),
    ("subnet_band", "bot_ratio DOUBLE", "STRING",
     "CASE WHEN bot_ratio > 0.5D THEN 'bot' WHEN bot_ratio > 0.2D THEN 'warn' ELSE 'human' END"),
]
REPORTS = [
    ("report_top_paths", "max_rows INT DEFAULT 20", "path STRING, total BIGINT, bots BIGINT, humans BIGINT",
     _top(f"SELECT coalesce(path, '{NO_PATH}') AS path, count(*) AS total, {_BOTS} AS bots, {_HUMANS} AS humans "
          "FROM bot_events GROUP BY 1", "path, total, bots, humans", "total DESC, path")),
    ("report_subnets", "max_rows INT DEFAULT 15",
     "cidr_block STRING, total BIGINT, bots BIGINT, humans BIGINT, bot_ratio DOUBLE, band STRING",
     _top(f"SELECT cidr_block, count(*) AS total, {_BOTS} AS bots, {_HUMANS} AS humans FROM bot_events "
          "WHERE cidr_block <> '' GROUP BY cidr_block",
          "cidr_block, total, bots, humans, share_of(bots, total), subnet_band(share_of(bots, total))", "total DESC, cidr_block")),
    ("report_flagged", "max_rows INT DEFAULT 20", "ip STRING, req_count BIGINT, max_risk DOUBLE",
     _top("SELECT ip, count(*) AS req_count, max(risk_score) AS max_risk FROM bot_events WHERE is_bot = 1 GROUP BY ip",
          "ip, req_count, max_risk", "req_count DESC, ip")),
    ("report_recent", "max_rows INT DEFAULT 12, before_id BIGINT DEFAULT NULL",
     "event_id BIGINT, ip STRING, timestamp DOUBLE, path STRING, risk_score DOUBLE, is_bot INT, cidr_block STRING",
     _top("SELECT event_id, ip, timestamp, path, risk_score, coalesce(is_bot, 0) AS is_bot, cidr_block FROM bot_events "
          "WHERE before_id IS NULL OR event_id < before_id",
          "event_id, ip, timestamp, path, risk_score, is_bot, cidr_block", "event_id DESC")),
    ("report_timeseries", "seconds INT DEFAULT 300", "t BIGINT, bots BIGINT, humans BIGINT",
     f"SELECT time_bucket(timestamp, seconds), {_BOTS}, {_HUMANS} FROM bot_events GROUP BY 1"),
    ("report_throughput", "seconds INT DEFAULT 300", "bucket TIMESTAMP, requests BIGINT",
     "SELECT timestamp_seconds(time_bucket(timestamp, seconds)), count(*) FROM bot_events GROUP BY 1"),
    ("report_risk_bins", "bins INT DEFAULT 20", "risk_bin DOUBLE, n BIGINT",
     "SELECT floor(risk_score * bins) / CAST(bins AS DOUBLE), count(*) FROM bot_events WHERE risk_score IS NOT NULL GROUP BY 1"),
    ("report_over_limit", "per_minute INT DEFAULT 100", "client STRING, minute BIGINT, requests BIGINT",
     "SELECT ip, time_bucket(timestamp, 60), count(*) FROM bot_events WHERE ip IS NOT NULL GROUP BY 1, 2 HAVING count(*) > per_minute"),
]


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names. Reports need the view `bot_events`."""
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    for name, arguments, result, body in EXPRESSIONS:
        spark.sql(f"{create} {name}({arguments}) RETURNS {result} RETURN {body}")
    reports = REPORTS if spark.catalog.tableExists("bot_events") else []
    for name, arguments, result, body in reports:
        spark.sql(f"{create} {name}({arguments}) RETURNS TABLE ({result}) RETURN {body}")
    return [f[0] for f in [*EXPRESSIONS, *reports]]
