"""Time the feature job on a log of the size the published figure is for (4.09 M requests),
plain and with one client owning a third of all requests.

    python tests/scale_run.py FOLDER [copies]      # FOLDER: an empty scratch folder
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(folder: str, copies: int = 41) -> None:
    from pyspark.sql import functions as F

    from crawlsight.operators import features, sessions
    from crawlsight.session import build_session
    from crawlsight.sources import sample_log

    spark = build_session("scale", "local[8]", **{
        "spark.sql.shuffle.partitions": 16, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    events = sample_log.read_events(spark, "/root/testdata/sf0.1")
    # more clients and more requests of the same kind; ids stay unique
    more = events.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumns({
        "event_id": F.col("event_id") * copies + F.col("k"),
        "user_id": F.col("user_id") + F.col("k") * 1500}).drop("k")
    log = sample_log.access_log(more)
    hot = log.withColumn("ip", F.when(F.col("event_id") % 3 == 0, "10.9.9.9").otherwise(F.col("ip")))
    for name, df in {"plain": log, "hot": hot}.items():
        path = f"{folder}/{name}"
        df.repartition(16).write.parquet(path)
        stored = spark.read.parquet(path)
        for job, run in {"features": features.ip_features, "sessions": sessions.session_summary,
                         "enrich": sessions.enrich_requests}.items():
            for turn in range(2):
                start = time.perf_counter()
                run(stored).write.format("noop").mode("overwrite").save()
                took = time.perf_counter() - start
            print(f"{name} {job}: {stored.count():,} requests, "
                  f"{stored.select('ip').distinct().count():,} clients, {took:.2f} s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
