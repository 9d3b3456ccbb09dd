"""Access log, event log and label stand-ins derived from the `events` test table.

Narrow projections only, so they work on batch and streaming reads alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
DAY_ZERO = 1704067200

# User agents by user_id % 8, allowlist lines.
USER_AGENTS = {
    0: "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    1: "curl/8.5.0",
    2: "-",
    3: "",
    4: "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Safari/605.1.15",
    6: "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    7: "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
}
ALLOWLIST_LINES = ["# trusted clients", "127.0.0.1", "::1", "10.0.0.0/24", "10.0.0.0/40"]


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events*.parquet")


_SQUEEZE = "CASE WHEN user_id % 17 = 3 THEN 30000 WHEN user_id % 5 = 1 THEN 6000 ELSE 30 END"
_OFFSET = (f"(unix_micros(CAST(ts AS TIMESTAMP)) - {DAY_ZERO} * 1000000L)"
           f" DIV ({_SQUEEZE} * 1000000L)")
_AGENT = "CASE user_id % 8 " + " ".join(
    f"WHEN {slot} THEN '{name}'" for slot, name in USER_AGENTS.items()) + " END"

ACCESS_LOG = {
    "event_id": "event_id",
    "ip": """CASE WHEN event_id % 997 = 996 THEN NULL
                  WHEN user_id % 29 = 28 THEN concat('2001:db8::', user_id)
                  WHEN user_id % 11 = 10 THEN concat('216.244.', 50000 + user_id % 15000)
                  ELSE concat_ws('.', '10', user_id % 3, user_id % 7, user_id % 250) END""",
    "epoch_s": f"{DAY_ZERO} + {_OFFSET}",
    "ts": f"timestamp_seconds({DAY_ZERO} + {_OFFSET})",
    "raw_ts": "CAST(ts AS TIMESTAMP)",
    "useragent": _AGENT,
    "path": """CASE WHEN event_id % 101 = 100 THEN NULL WHEN user_id % 13 = 4 THEN '/robots.txt'
                    ELSE concat('/', event_type, '/', get_json_object(props, '$.k')) END""",
    "method": "CASE event_type WHEN 'signup' THEN 'POST' WHEN 'error' THEN 'HEAD' ELSE 'GET' END",
    "status_code": """CASE WHEN event_type = 'error' AND value > 30 THEN 500
                           WHEN event_type = 'error' THEN 404
                           WHEN user_id % 13 = 0 AND event_type IN ('view', 'click', 'signup') THEN 404
                           ELSE 200 END""",
    "bytes_sent": "CASE WHEN event_id % 103 = 102 THEN NULL ELSE floor(value * 100) END",
    # where a source labels its clients; about one client in ten here
    "gt_is_robot": "CASE user_id % 23 WHEN 5 THEN 1 WHEN 6 THEN 0 END",
    "user_id": "user_id", "event_type": "event_type", "value": "value",
}
# a given risk and verdict, unknown for some requests
SCORED = {
    "risk_score": "CASE WHEN event_id % 107 <> 106 THEN round(least(value / 100, 1.0D), 4) END",
    "is_bot": "CASE WHEN event_id % 107 <> 106 THEN int(value >= 50) END",
}


def _select(events: DataFrame, *columns: dict[str, str]) -> DataFrame:
    return events.selectExpr(*[f"{sql} AS {name}" for part in columns for name, sql in part.items()])


def access_log(events: DataFrame) -> DataFrame:
    return _select(events, ACCESS_LOG)


def scored_requests(events: DataFrame) -> DataFrame:
    """The access log with risk and verdict: input of the event log."""
    return _select(events, ACCESS_LOG, SCORED)


def labelled_scores(events: DataFrame) -> DataFrame:
    """Scores with a 0/1 truth for threshold searches."""
    return (_select(events, {"event_id": "event_id", "score": SCORED["risk_score"],
                             "label": "int(value + (event_id % 7) * 8 > 70)"})
            .filter("score IS NOT NULL"))


def forwarded_requests(events: DataFrame) -> DataFrame:
    """Requests as a proxy hands them on: a quarter names another first hop."""
    ip = ACCESS_LOG["ip"]
    return _select(events, ACCESS_LOG, {"forwarded_for": f"""
        CASE event_id % 4 WHEN 1 THEN concat_ws(', ', concat(' 198.51.100.', user_id % 200), {ip})
                          WHEN 2 THEN '' END"""})
