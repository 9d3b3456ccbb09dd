"""Scoring of clients and requests.

The rule-based score is one projection. A fitted MLlib pipeline can take its place: pass
`model` and `threshold`, and the same functions score with it.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import useragent, verdicts
from ..functions.numbers import model_input
from ..schemas import MODEL_FEATURES
from ..session import written
from .allowlist import flag_allowlisted

_MODEL_COLUMNS = ("features_raw", "features", "rawPrediction", "probability", "prediction")


def score_heuristic(df: DataFrame, threshold: float = verdicts.DEFAULT_THRESHOLD) -> DataFrame:
    """Add risk_score, is_bot and reason by rule."""
    risk = verdicts.heuristic_risk(F.col("ua_is_known_bot"), F.col("rate_404"))
    return df.withColumn("risk_score", risk).withColumns({
        "is_bot": F.col("risk_score") >= threshold,
        "reason": F.lit(verdicts.HEURISTIC_REASON)})


def score_with_model(df: DataFrame, model: PipelineModel, threshold: float,
                     features: list[str] = MODEL_FEATURES) -> DataFrame:
    """Add risk_score, is_bot and reason by a fitted pipeline; missing inputs count as 0.

    The verdict compares the unrounded probability.
    """
    kept = df.columns
    inputs = {f"_in_{c}": model_input(F.col(c)) if c in kept else F.lit(0.0) for c in features}
    scored = model.transform(df.withColumns(inputs)).withColumn(
        "_p", vector_to_array("probability")[1])
    is_bot = F.col("_p") >= threshold
    reason = verdicts.explain(F.col("ua_is_known_bot"), F.col("rate_404"),
                              F.col("requests_per_hour"), F.col("unique_paths_ratio"), is_bot)
    return scored.select(*kept, F.round("_p", 4).alias("risk_score"), is_bot.alias("is_bot"),
                         reason.alias("reason"))


def score(df: DataFrame, model: PipelineModel | None = None,
          threshold: float = verdicts.DEFAULT_THRESHOLD) -> DataFrame:
    if model is None:
        return score_heuristic(df, threshold)
    return score_with_model(df, model, threshold)


def explain_verdicts(df: DataFrame, threshold: float = verdicts.DEFAULT_THRESHOLD) -> DataFrame:
    """Reason text for rows that carry features and `risk_score`."""
    reason = verdicts.explain(F.col("ua_is_known_bot"), F.col("rate_404"),
                              F.col("requests_per_hour"), F.col("unique_paths_ratio"),
                              F.col("risk_score") >= threshold)
    return df.withColumn("reason", reason)


def _agent_columns(ua: Column) -> dict[str, Column]:
    return {"ua_is_known_bot": useragent.is_known_bot(ua).cast("int"),
            "ua_is_browser": useragent.is_browser(ua).cast("int"),
            "ua_entropy": useragent.char_entropy(ua)}


def with_profiles(requests: DataFrame, profiles: DataFrame, shared_agents: bool = False) -> DataFrame:
    """Requests with the stored profile of their client and the user-agent features of the
    request itself, which win over the stored ones when a user agent was sent.

    One hot client skews only the request side; adaptive execution splits it. With
    `shared_agents` the features are computed once per distinct user agent and joined back:
    worth it where the entropy is used. The planner sees the size of that table.
    """
    cells = [c for c in profiles.columns if c != "ip" and c not in requests.columns]
    joined = requests.join(profiles.select("ip", *cells), "ip", "left")
    ua = F.col("useragent")
    fresh = _agent_columns(ua)
    if shared_agents:
        agents = requests.select("useragent").filter(ua.isNotNull()).distinct()
        table = written(agents.select("useragent", *[
            col.alias(f"_{name}") for name, col in fresh.items()]), "agents")
        joined = joined.join(table, "useragent", "left")
        fresh = {name: F.col(f"_{name}") for name in fresh}
    merged = joined.withColumns({
        c: F.when(ua.isNotNull(), fresh[c]).otherwise(F.col(c)) for c in fresh})
    return merged.drop(*[f"_{c}" for c in fresh])


def score_requests(requests: DataFrame, profiles: DataFrame, model: PipelineModel | None = None,
                   threshold: float = verdicts.DEFAULT_THRESHOLD) -> DataFrame:
    """Score requests on profile and user agent; clients without profile on the agent alone."""
    stored = profiles.drop("risk_score", "is_bot", "threshold_used", "model_version")
    joined = with_profiles(requests, stored, shared_agents=model is not None)
    scored = score(joined, model, threshold)
    zero = F.lit(0).cast("bigint")
    return scored.withColumns({"req_count": F.coalesce("req_count", zero),
                               "session_count": F.coalesce("session_count", zero)})


def decide(scored: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Add allowlist flag, decision, HTTP status, action and threat tier.

    An allowlisted client has risk 0 whatever was computed.
    """
    flagged = flag_allowlisted(scored, allowlist)
    trusted = F.col("allowlisted")
    clean = flagged.withColumns({
        "risk_score": F.when(trusted, F.lit(0.0)).otherwise(F.col("risk_score")),
        "is_bot": F.col("is_bot") & ~trusted,
        "reason": F.when(trusted, verdicts.ALLOWLIST_REASON).otherwise(F.col("reason")),
    })
    outcome = verdicts.decision(F.col("risk_score"), F.col("is_bot"), trusted)
    return (clean.withColumn("_outcome", outcome)
            .select(*clean.columns, "_outcome.*")
            .withColumn("threat", verdicts.threat_tier(F.col("risk_score"), F.col("is_bot"))))


def bulk_score(wanted: DataFrame, profiles: DataFrame, allowlist: DataFrame,
               model: PipelineModel | None = None,
               threshold: float = verdicts.DEFAULT_THRESHOLD) -> DataFrame:
    """Scores for a list of addresses (`pos`, `ip`) in list order, repeats kept.

    Each distinct address is looked up and scored once.
    """
    stored = profiles.drop("risk_score", "is_bot", "threshold_used", "model_version")
    distinct = flag_allowlisted(wanted.select("ip").distinct(), allowlist)
    scored = score(distinct.join(stored, "ip", "left"), model, threshold).select(
        "ip",
        F.when(F.col("allowlisted"), F.lit(0.0)).otherwise(F.col("risk_score")).alias("risk_score"),
        (F.col("is_bot") & ~F.col("allowlisted")).alias("is_bot"))
    return wanted.join(scored, "ip").select("pos", "ip", "risk_score", "is_bot").orderBy("pos")


def signal_breakdown(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per signal of each row of `df`, identified by `keys` and `pos`.

    Rows that `df.allowlisted` marks have the allowlist signal alone.
    """
    found = verdicts.signals(F.col)
    if "allowlisted" in df.columns:
        found = F.when(F.col("allowlisted"), verdicts.allowlist_signal()).otherwise(found)
    return (df.select(*keys, F.posexplode(found).alias("pos", "signal"))
            .select(*keys, "pos", "signal.*"))


def flagged_ips(scored: DataFrame) -> DataFrame:
    return scored.filter("is_bot").select("ip").distinct()
