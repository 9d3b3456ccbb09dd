"""Client profiles: seeding, merging, alerts.

A profile update carries only the cells it knows. Updates are rows with `updated_at`;
the current profile takes, cell by cell, the newest known value. Aggregating instead of
rewriting makes an update cost its own size, and many updates of one client combine
before the shuffle.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import useragent, verdicts
from ..schemas import PROFILE, PROFILE_CELLS, PROFILE_FAMILIES
from .scoring import score

ALERT_TTL_SECONDS = 3600
MODEL_VERSION = "1.0.0"
RULES_VERSION = "heuristic"


def profile_rows(df: DataFrame) -> DataFrame:
    """`df` on the profile columns; cells it lacks are NULL."""
    return df.select("ip", *[
        (F.col(c) if c in df.columns else F.lit(None)).cast(PROFILE[c].dataType).alias(c)
        for c in PROFILE_CELLS])


def seed_profiles(features: DataFrame, model: PipelineModel | None = None,
                  threshold: float = verdicts.DEFAULT_THRESHOLD,
                  model_version: str = RULES_VERSION) -> DataFrame:
    """Profiles of a whole feature table, scored in the same pass."""
    return profile_rows(score(features, model, threshold).withColumns({
        "threshold_used": F.lit(threshold), "model_version": F.lit(model_version)}))


def check_updates(scored: DataFrame, threshold: float = verdicts.DEFAULT_THRESHOLD,
                  model_version: str = RULES_VERSION) -> DataFrame:
    """The update scored requests write, one row per client: score and user-agent features of
    its newest request (by `updated_at`, then the higher risk)."""
    newest = scored.groupBy("ip").agg(F.max(F.struct(
        "updated_at", "risk_score", F.col("is_bot").cast("int").alias("is_bot"),
        F.coalesce("useragent", F.lit("")).alias("useragent"))).alias("r")).select("ip", "r.*")
    ua = F.col("useragent")
    return newest.select(
        "ip", "updated_at", "risk_score", "is_bot",
        useragent.is_known_bot(ua).cast("int").alias("ua_is_known_bot"),
        useragent.is_browser(ua).cast("int").alias("ua_is_browser"),
        useragent.char_entropy(ua).alias("ua_entropy"),
        F.lit(threshold).alias("threshold_used"), F.lit(model_version).alias("model_version"))


def latest_cells(updates: DataFrame, *extra: Column) -> DataFrame:
    """Collapse updates to one row per client: the newest non-NULL value of every cell."""
    cells = [c for c in updates.columns if c in PROFILE_CELLS]
    return updates.groupBy("ip").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(c)
        for c in cells], *extra)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge one-row-per-client updates into profiles: known new cells win."""
    old, new = profile_rows(old).alias("old"), profile_rows(new).alias("new")
    cell = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c)
    return (old.join(new, F.col("old.ip") == F.col("new.ip"), "full_outer")
            .select(cell("ip"), *[cell(c) for c in PROFILE_CELLS]))


def as_families(profiles: DataFrame) -> DataFrame:
    """Profiles with one struct per cell family."""
    return profiles.select("ip", *[F.struct(*cells).alias(family)
                                   for family, cells in PROFILE_FAMILIES.items()])


def profile_lookup(profiles: DataFrame) -> DataFrame:
    """Family structs flattened to plain columns."""
    return profiles.select("ip", *[f"{family}.*" for family in PROFILE_FAMILIES])


def alerts(flagged: DataFrame, profiles: DataFrame) -> DataFrame:
    """Alert rows for flagged clients (`ip`, `flagged_at`, `reason`, optional `request_count`);
    the stored request count fills a missing one."""
    counts = profiles.select("ip", F.col("req_count").alias("_stored"))
    given = F.col("request_count") if "request_count" in flagged.columns else F.lit(None)
    return flagged.join(counts, "ip", "left").select(
        "ip", "flagged_at", "reason",
        F.coalesce(given.cast("bigint"), "_stored", F.lit(0).cast("bigint"))
        .alias("request_count_at_flag"))


def newest_alerts(alert_rows: DataFrame) -> DataFrame:
    """Newest alert per client; within one second the one with most requests."""
    newest = F.max(F.struct("flagged_at", "request_count_at_flag", "reason"))
    return alert_rows.groupBy("ip").agg(newest.alias("a")).select(
        "ip", "a.flagged_at", "a.reason", "a.request_count_at_flag")


def active_alerts(alert_rows: DataFrame, now: Column, ttl: int = ALERT_TTL_SECONDS) -> DataFrame:
    """Newest alert per client that has not expired at `now` (epoch seconds)."""
    return newest_alerts(alert_rows.filter(
        (F.col("flagged_at") > now - ttl) & (F.col("flagged_at") <= now)))
