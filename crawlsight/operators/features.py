"""Per-client behaviour features.

Three partial tables carry everything a feature row needs, and each of them merges by
adding rows: the partials of two slices of a log are the partials of the whole log.

* seconds: counts and sums per (client, second)
* paths:   distinct (client, path)
* agents:  first appearance per (client, user agent)

All three are built with map-side aggregation, so a client with a third of the log is
reduced before the shuffle, and user-agent patterns run once per (client, agent).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock, useragent, verdicts
from .sessions import HOUR, SESSION_GAP_SECONDS, usable_requests

_SUMS = ["requests", "errors", "not_found", "bytes_sum", "bytes_n"]
_SUM_COLUMNS = [f"sum({c}) AS {c}" for c in _SUMS] + ["max(truth) AS truth"]


def _agg(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    return df.groupBy(*keys).agg(*map(F.expr, columns))


@dataclass(frozen=True)
class Partials:
    seconds: DataFrame
    paths: DataFrame
    agents: DataFrame

    def union(self, other: "Partials") -> "Partials":
        return Partials(self.seconds.unionByName(other.seconds),
                        self.paths.unionByName(other.paths),
                        self.agents.unionByName(other.agents))


def partials(log: DataFrame) -> Partials:
    """Partial tables of a slice of the log (ip, epoch_s, useragent, path, status_code,
    bytes_sent and, where the source has one, gt_is_robot)."""
    log = usable_requests(log)
    truth = "gt_is_robot" if "gt_is_robot" in log.columns else "CAST(NULL AS INT)"
    seconds = _agg(
        log, ["ip", "epoch_s"],
        "count(1) AS requests",
        "count_if(status_code >= 400) AS errors",
        "count_if(status_code = 404) AS not_found",
        "sum(bytes_sent) AS bytes_sum",
        "count(bytes_sent) AS bytes_n",
        f"max({truth}) AS truth")
    paths = log.filter(F.col("path").isNotNull()).select("ip", "path").distinct()
    agents = (log.withColumn("useragent", F.coalesce("useragent", F.lit("")))
              .groupBy("ip", "useragent")
              .agg(F.min("epoch_s").alias("first_s")))
    return Partials(seconds, paths, agents)


def merge(parts: Partials) -> Partials:
    """One row per key again after a union of slices."""
    return Partials(_agg(parts.seconds, ["ip", "epoch_s"], *_SUM_COLUMNS),
                    parts.paths.distinct(),
                    _agg(parts.agents, ["ip", "useragent"], "min(first_s) AS first_s"))


def _hours(seconds: DataFrame, gap_seconds: int) -> DataFrame:
    """Per (client, hour): sums, and the gaps between its active seconds."""
    gapped = seconds.selectExpr("*", f"epoch_s DIV {HOUR} AS hour").selectExpr(
        "*", "epoch_s - lag(epoch_s) OVER (PARTITION BY ip, hour ORDER BY epoch_s) AS gap")
    return _agg(
        gapped, ["ip", "hour"], *_SUM_COLUMNS,
        "min(epoch_s) AS first_s", "max(epoch_s) AS last_s",
        "sum(gap * gap) AS gap_squares", "min(gap) AS min_gap",
        "max(requests) > 1 AS shared_second",
        f"count_if(gap > {gap_seconds}) AS breaks")


def _behaviour(seconds: DataFrame, gap_seconds: int) -> DataFrame:
    """Per client: the hours and the gaps between them put together.

    The gaps are whole numbers and add up to the span, so their deviation comes from exact
    sums; the subtraction is done in decimals.
    """
    hours = _hours(seconds, gap_seconds).selectExpr(
        "*", "first_s - lag(last_s) OVER (PARTITION BY ip ORDER BY hour) AS edge")
    total = _agg(
        hours, ["ip"], *_SUM_COLUMNS,
        "min(first_s) AS first_s", "max(last_s) AS last_s",
        "sum(coalesce(gap_squares, 0) + coalesce(edge * edge, 0)) AS gap_squares",
        "min(least(min_gap, edge)) AS min_gap", "max(shared_second) AS shared_second",
        f"sum(breaks) + count_if(edge > {gap_seconds}) + 1 AS sessions")
    sized = total.selectExpr(
        "*", "requests - 1 AS gaps", "last_s - first_s AS span",
        "CAST(gap_squares AS DECIMAL(19, 0)) AS squares_exact",
        "CAST(last_s - first_s AS DECIMAL(19, 0)) AS span_exact",
        "CAST(requests - 1 AS DECIMAL(19, 0)) AS gaps_exact")
    return sized.selectExpr(
        "ip", "requests AS req_count",
        "CASE WHEN gaps > 0 THEN span / gaps ELSE 0D END AS avg_interval",
        """CASE WHEN gaps > 1 THEN sqrt(CAST(gaps_exact * squares_exact - span_exact * span_exact
               AS DOUBLE) / (CAST(gaps AS DOUBLE) * (gaps - 1))) ELSE 0D END AS std_interval""",
        "CAST(CASE WHEN shared_second THEN 0 ELSE coalesce(min_gap, 0) END AS DOUBLE) AS min_interval",
        "requests / greatest(span / 3600D, 1D / 3600D) AS requests_per_hour",
        "sessions AS session_count", "requests / sessions AS avg_session_length",
        "errors / requests AS error_rate", "not_found / requests AS rate_404",
        "CASE WHEN bytes_n > 0 THEN bytes_sum / bytes_n ELSE 0D END AS avg_bytes",
        "first_s", "last_s", "truth")


def _agents(agents: DataFrame) -> DataFrame:
    """Flags over all user agents; entropy of the earliest usable one (by name within a second)."""
    ua = F.col("useragent")
    per_client = agents.groupBy("ip").agg(
        F.max(useragent.is_known_bot(ua).cast("int")).alias("ua_is_known_bot"),
        F.max(useragent.is_browser(ua).cast("int")).alias("ua_is_browser"),
        F.min_by(ua, F.when(useragent.is_usable(ua), F.struct("first_s", ua))).alias("sample"),
    )
    return per_client.select("ip", "ua_is_known_bot", "ua_is_browser",
                             useragent.char_entropy(F.col("sample")).alias("ua_entropy"))


def finish(parts: Partials, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """The feature table, one row per client."""
    behaviour = _behaviour(parts.seconds, gap_seconds)
    variety = parts.paths.groupBy("ip").agg(F.count(F.lit(1)).alias("distinct_paths"))
    joined = (behaviour.join(_agents(parts.agents), "ip")
              .join(variety, "ip", "left"))
    ratio = F.coalesce("distinct_paths", F.lit(0)) / F.col("req_count")
    seen = lambda c: clock.as_instant(F.col(c))
    return joined.select(
        "ip", "req_count", "avg_interval", "std_interval", "min_interval", "requests_per_hour",
        "session_count", "avg_session_length", ratio.alias("unique_paths_ratio"), "error_rate",
        "rate_404", "avg_bytes", "ua_is_known_bot", "ua_is_browser", "ua_entropy",
        clock.iso_seconds(seen("first_s")).alias("first_seen"),
        clock.iso_seconds(seen("last_s")).alias("last_seen"),
        F.to_date(seen("last_s")).alias("date"),
        verdicts.robot_label(F.col("truth"), F.col("ua_is_known_bot"), F.col("rate_404"))
        .alias("is_robot"),
    )


def ip_features(log: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Features of a whole log."""
    return finish(partials(log), gap_seconds)


def ip_features_merged(slices: list[DataFrame], gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Features from slices of a log (days, files, regions) reduced separately."""
    whole = partials(slices[0])
    for part in slices[1:]:
        whole = whole.union(partials(part))
    return finish(merge(whole), gap_seconds)


def ua_features(log: DataFrame) -> DataFrame:
    """Flags and entropy, once per distinct user agent."""
    ua = F.col("useragent")
    return log.select(F.coalesce(ua, F.lit("")).alias("useragent")).distinct().select(
        ua, useragent.is_known_bot(ua).cast("int").alias("ua_is_known_bot"),
        useragent.is_browser(ua).cast("int").alias("ua_is_browser"),
        useragent.char_entropy(ua).alias("ua_entropy"))
