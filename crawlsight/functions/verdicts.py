"""Verdict expressions: label, risk, reason, signals, decision, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import grouped_number

# Thresholds, bands and wording of the verdicts.
DEFAULT_THRESHOLD = 0.5
BLOCK_THRESHOLD = 0.85
HEURISTIC_RISK = (0.9, 0.1)
HEURISTIC_REASON = "heuristic: known-bot UA or rate_404>0.5"
ALLOWLIST_REASON = "allowlisted"
DECISION_ACTIONS = {
    "allowlisted": ("allow", 200, "Allowlisted — normal flow"),
    "block": ("block", 429, "High-confidence bot — request blocked"),
    "throttle": ("throttle", 429, "Bot detected — rate-limited (HTTP 429)"),
    "allow": ("allow", 200, "Human traffic — normal flow"),
}


def behaviour_label(known_bot: Column, rate_404: Column) -> Column:
    return F.when((known_bot == 1) | (rate_404 > 0.5), 1).otherwise(0)


def robot_label(truth: Column, known_bot: Column, rate_404: Column) -> Column:
    """Ground truth where there is one, else the behaviour rule."""
    return F.coalesce(truth.cast("int"), behaviour_label(known_bot, rate_404))


def heuristic_risk(known_bot: Column, rate_404: Column) -> Column:
    high, low = HEURISTIC_RISK
    suspicious = (F.coalesce(known_bot, F.lit(0)) != 0) | (F.coalesce(rate_404, F.lit(0.0)) > 0.5)
    return F.when(suspicious, F.lit(high)).otherwise(F.lit(low))


def _or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def explain(known_bot: Column, rate_404: Column, per_hour: Column, path_ratio: Column,
            is_bot: Column) -> Column:
    """Reasons in fixed order joined by '; ', or the side of the threshold.

    A path ratio of 0 counts as unknown and gives no reason.
    """
    ratio = F.coalesce(F.nullif(path_ratio.cast("double"), F.lit(0.0)), F.lit(1.0))
    reasons = F.concat_ws(
        "; ",
        F.when(_or_zero(known_bot) == 1, F.lit("known-bot user-agent")),
        F.when(_or_zero(rate_404) > 0.5, F.lit("high 404 rate")),
        F.when(_or_zero(per_hour) > 1000, F.lit("high request rate")),
        F.when(ratio < 0.05, F.lit("repetitive paths")),
    )
    side = F.when(is_bot, F.lit("model score above threshold")).otherwise(
        F.lit("model score below threshold"))
    return F.when(reasons != "", reasons).otherwise(side)


def decision(risk: Column, is_bot: Column, allowlisted: Column,
             block_at: float = BLOCK_THRESHOLD) -> Column:
    """Struct of decision, http_status and action."""
    def outcome(key: str) -> Column:
        name, status, action = DECISION_ACTIONS[key]
        return F.struct(F.lit(name).alias("decision"), F.lit(status).alias("http_status"),
                        F.lit(action).alias("action"))

    return (F.when(allowlisted, outcome("allowlisted"))
            .when(is_bot & (risk >= block_at), outcome("block"))
            .when(is_bot, outcome("throttle"))
            .otherwise(outcome("allow")))


def threat_tier(risk: Column, is_bot: Column) -> Column:
    return (F.when(is_bot | (risk > 0.7), "CRITICAL")
            .when(risk > 0.4, "HIGH").when(risk > 0.2, "MEDIUM").otherwise("SAFE"))


def subnet_band(bot_ratio: Column) -> Column:
    return F.when(bot_ratio > 0.5, "bot").when(bot_ratio > 0.2, "warn").otherwise("human")


def _signal(key: str, label: str, value, severity, note) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"),
                    as_col(value).alias("value"), as_col(severity).alias("severity"),
                    as_col(note).alias("note"))


def _pick(test: Column, yes: str, no: str) -> Column:
    return F.when(test, yes).otherwise(no)


def _levels(value: Column, danger: float, warn: float) -> Column:
    return F.when(value > danger, "danger").when(value > warn, "warn").otherwise("ok")


def allowlist_signal() -> Column:
    """The only signal of an allowlisted address."""
    return F.array(_signal("allow", "Allowlist", "trusted", "ok",
                           "IP is on the allowlist — scoring skipped"))  # fixed wording


def signals(features) -> Column:
    """Ordered array of {key, label, value, severity, note}.

    `features` maps a feature name to its column; a client without history gets
    the user-agent signals only.
    """
    # Keys, labels, bands and wording of the signals.
    f = {name: _or_zero(features(name)) for name in (
        "req_count", "ua_is_known_bot", "ua_is_browser", "rate_404", "requests_per_hour",
        "unique_paths_ratio", "error_rate", "ua_entropy", "session_count")}
    known, browser = f["ua_is_known_bot"] == 1, f["ua_is_browser"] == 1
    r404, rph, upr, err = (f["rate_404"], f["requests_per_hour"], f["unique_paths_ratio"],
                           f["error_rate"])
    percent = lambda share: F.concat(grouped_number(share * 100, 0), F.lit("%"))

    agent = _signal(
        "ua", "User-Agent",
        F.when(known, "known bot").when(browser, "browser").otherwise("unrecognized"),
        F.when(known, "danger").when(browser, "ok").otherwise("warn"),
        F.when(known, "Matches a crawler/bot signature")
        .when(browser, "Recognized browser fingerprint")
        .otherwise("Neither a known browser nor a known bot"))
    history = F.array(
        agent,
        _signal("rate_404", "404 rate", percent(r404), _levels(r404, 0.5, 0.2),
                _pick(r404 > 0.2, "Scanning for endpoints", "Normal not-found rate")),
        _signal("rph", "Request rate", F.concat(grouped_number(rph, 0), F.lit("/hr")),
                _levels(rph, 1000, 200),
                _pick(rph > 200, "Automated-level throughput", "Human-level pace")),
        _signal("upr", "Path diversity", grouped_number(upr, 2),
                F.when(upr < 0.05, "danger").when(upr < 0.2, "warn").otherwise("ok"),
                _pick(upr < 0.2, "Highly repetitive paths", "Varied browsing")),
        _signal("err", "Error rate", percent(err), _pick(err > 0.5, "warn", "ok"),
                _pick(err > 0.5, "Many failed requests", "Mostly successful")),
        _signal("vol", "Volume",
                F.concat(grouped_number(f["req_count"], 0), F.lit(" reqs / "),
                         grouped_number(f["session_count"], 0), F.lit(" sess")),
                "info", "Observed in the dataset"))
    unseen = F.array(agent, _signal("history", "Behavioural history", "none", "info",
                                    "Unseen IP — scored on User-Agent only"))
    entropy = F.array(_signal("entropy", "UA entropy",
                              F.concat(grouped_number(f["ua_entropy"], 2), F.lit(" bits")),
                              "info", "Character randomness of the User-Agent"))
    return F.concat(F.when(f["req_count"] > 0, history).otherwise(unseen), entropy)
