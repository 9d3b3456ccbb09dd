"""Live request checks: score each micro-batch and keep its events, profiles and alerts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import verdicts
from ..operators import profiles as profile_ops
from ..operators import scoring, validation
from ..sources import event_log, profiles as profile_store
from ..sources.versioned_profiles import VersionedProfiles
from .run import snapshots


FOLD_EVERY = 32  # micro-batches


@dataclass(frozen=True)
class CheckTables:
    """Paths below one folder."""
    folder: str

    @property
    def decisions(self) -> str:
        return f"{self.folder}/decisions"

    @property
    def events(self) -> str:
        return f"{self.folder}/events"

    @property
    def profiles(self) -> str:
        return f"{self.folder}/profiles"

    @property
    def alerts(self) -> str:
        return f"{self.folder}/alerts"


def check(requests: DataFrame, profiles: DataFrame, allowlist: DataFrame,
          model: PipelineModel | None = None,
          threshold: float = verdicts.DEFAULT_THRESHOLD) -> DataFrame:
    """Valid requests with risk, verdict, reason and decision."""
    valid = validation.valid_requests(requests)
    return scoring.decide(scoring.score_requests(valid, profiles, model, threshold), allowlist)


def persist_checks(decided: DataFrame, profiles: DataFrame, tables: CheckTables, batch_id,
                   threshold: float = verdicts.DEFAULT_THRESHOLD,
                   model_version: str = profile_ops.RULES_VERSION,
                   versions: VersionedProfiles | None = None) -> None:
    """Write events, profile updates and alerts of checked requests as one batch; profiles go to
    `versions` where it is given.

    Allowlisted requests leave no trace. Each table replaces the batch when it runs again.
    """
    seen = decided.filter(~F.col("allowlisted"))
    event_log.append_events(seen.withColumn("is_bot", F.col("is_bot").cast("int")),
                            tables.events, batch_id)
    updates = profile_ops.check_updates(
        seen.withColumn("updated_at", F.col("timestamp")), threshold, model_version)
    if versions is None:
        profile_store.write_updates(updates, tables.profiles, batch_id)
    else:
        versions.append(updates, batch_id)
    flagged = (seen.filter("is_bot").groupBy("ip", "reason")
               .agg(F.max("timestamp").cast("bigint").alias("flagged_at")))
    profile_store.write_alerts(profile_ops.alerts(flagged, profiles), tables.alerts, batch_id)


def batch_handler(spark: SparkSession, tables: CheckTables, allowlist: DataFrame,
                  base_profiles: DataFrame | None = None, model: PipelineModel | None = None,
                  threshold: float = verdicts.DEFAULT_THRESHOLD,
                  model_version: str = profile_ops.RULES_VERSION,
                  persist: bool = True, versions: VersionedProfiles | None = None) -> Callable[[DataFrame, int], None]:
    """Handler for `run.to_batches` over requests (`event_id`, `ip`, `timestamp`, `useragent`,
    `path`). Profiles are the stored ones on top of `base_profiles`; decisions are always kept,
    events, profiles and alerts with `persist`.

    A micro-batch reads the profiles of its own clients, and every `FOLD_EVERY`th folds what the
    earlier ones have stored, so its cost does not grow with their number. With `versions` the
    profiles lie in that store, whose buckets grow in number with it, so that neither does the
    cost of a micro-batch grow with the number of clients."""
    keep_decisions = snapshots(tables.decisions)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if persist and batch_id % FOLD_EVERY == 0:
            if versions is None:
                profile_store.fold(spark, tables.profiles, without_batch=batch_id)
            else:
                versions.fold(without_batch=batch_id)
        clients = validation.valid_requests(batch).select("ip").distinct().persist()
        current = (profile_store.read_profiles(spark, tables.profiles, batch_id, clients) if versions is None
                   else versions.read(without_batch=batch_id, clients=clients))
        if base_profiles is not None:
            current = profile_ops.upsert(base_profiles.join(clients, "ip", "left_semi"), current)
        # the entropy is taken once per client by the profile updates, not per request
        decided = check(batch, current, allowlist, model, threshold).drop("ua_entropy").persist()
        try:
            keep_decisions(decided.select("event_id", "ip", "risk_score", "is_bot", "reason",
                                          "decision", "http_status", "threat"), batch_id)
            if persist:
                persist_checks(decided, current, tables, batch_id, threshold, model_version, versions)
        finally:
            decided.unpersist()
            clients.unpersist()

    return handle
