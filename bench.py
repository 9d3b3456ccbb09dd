"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = ["ip_features", "ip_features_two_level", "sessionize", "session_summary", "overview",
            "rate_histogram", "event_stats", "events_summary", "top_paths", "cidr_activity",
            "events_timeseries", "throughput_5m", "dow_hour_dense", "risk_histogram",
            "top_flagged_ips", "rate_limit_ip", "score_requests", "bulk_score", "decisions",
            "signal_breakdown", "threshold_sweep", "auc_roc", "cv_folds"]


def main() -> None:
    from crawlsight.gate.queries import QUERIES
    from crawlsight.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})  # scratch data goes to the warehouse
    spark.sparkContext.setLogLevel("ERROR")
    requests = spark.read.parquet(f"{sf_dir}/events.parquet").count()

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        timed(name)  # compiled once, as in a long-running session
        seconds[name] = round(timed(name), 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir), "requests": requests,
        "features_requests_per_sec": round(requests / seconds["ip_features"])
        if "ip_features" in seconds else None}))
    spark.stop()


if __name__ == "__main__":
    main()
