"""Temp views for Spark SQL users, one per table and per dashboard question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import rollups
from ..sources.metrics import feature_importances, model_comparison

FEATURE_VIEWS = {
    "overview": rollups.overview,
    "top_bots": rollups.top_bots,
    "rate_histogram": rollups.rate_histogram,
    "scatter_sample": rollups.scatter_sample,
}
EVENT_VIEWS = {
    "event_stats": rollups.event_stats,
    "events_summary": rollups.events_summary,
    "kpis": rollups.kpis,
    "class_share": rollups.class_share,
    "top_paths": rollups.top_paths,
    "cidr_activity": rollups.cidr_activity,
    "top_flagged_ips": rollups.top_flagged_ips,
    "throughput_5m": rollups.throughput,
    "throughput_10m_by_class": rollups.throughput_by_class,
    "events_timeseries": rollups.timeseries_share,
    "dow_hour_heatmap": rollups.dow_hour_dense,
    "risk_histogram": rollups.risk_histogram,
    "recent_events": rollups.recent_events,
    "alert_timeline": rollups.alert_timeline,
}
DOCUMENT_VIEWS = {"model_comparison": model_comparison,
                  "feature_importances": feature_importances}


def register(spark: SparkSession, access_log: DataFrame | None = None,
             features: DataFrame | None = None, bot_events: DataFrame | None = None,
             metrics: DataFrame | None = None) -> list[str]:
    """Register the given tables and the questions they can answer; returns the view names."""
    views = {"access_log": access_log, "features": features, "bot_events": bot_events,
             "metrics": metrics}
    for table, questions in ((features, FEATURE_VIEWS), (bot_events, EVENT_VIEWS),
                             (metrics, DOCUMENT_VIEWS)):
        if table is not None:
            views.update({name: ask(table) for name, ask in questions.items()})
    present = {name: df for name, df in views.items() if df is not None}
    for name, df in present.items():
        df.createOrReplaceTempView(name)
    return sorted(present)
