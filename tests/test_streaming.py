import random

from pyspark.sql import functions as F

from crawlsight.gate import queries
from crawlsight.operators import allowlist, features
from crawlsight.sources import event_log, profiles as store
from crawlsight.streaming import alerts, cells, checks, features as live, monitors, run

from test_sessions_features import SCHEMA, check_features, random_log


def test_features_over_batches_equal_the_batch_job(spark, folder):
    log = random_log(9)
    random.Random(3).shuffle(log)  # late and interleaved requests
    for i in range(3):
        spark.createDataFrame(log[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(folder + "/log")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/log")
    run.finish(run.to_batches(stream, live.partials_handler(folder), folder + "/checkpoint", once=True))
    assert spark.read.parquet(folder + "/seconds").select("batch_id").distinct().count() == 3
    check_features(live.current_features(spark, folder), log)
    live.partials_handler(folder)(spark.createDataFrame(log[2::3], SCHEMA), 2)  # a batch runs again
    live.compact(spark, folder, folder + "/compacted")
    assert spark.read.parquet(folder + "/compacted/paths").select("batch_id").distinct().count() == 1


def requests(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ip string, timestamp double, useragent string, path string")


def test_checks_are_repeatable_and_use_earlier_batches(spark, folder):
    allow = allowlist.parse_allowlist(spark.createDataFrame([("10.0.0.0/24",)], "value string"))
    tables = checks.CheckTables(folder)
    handle = checks.batch_handler(spark, tables, allow)
    first = requests(spark, [(1, "1.1.1.1", 100.0, "curl/8", "/"), (2, "10.0.0.9", 101.0, "curl/8", "/"),
                             (3, "bad host", 102.0, "x", "/"), (4, "2.2.2.2", 103.0, "Firefox/1", "/"),
                             (5, "1.1.1.1", 104.0, "Firefox/1", "/")])
    second = requests(spark, [(6, "1.1.1.1", 200.0, None, "/"), (7, "2.2.2.2", 201.0, None, "nopath")])
    handle(first, 0)
    for _ in range(2):
        handle(second, 1)
    decided = {r.event_id: r.decision for r in spark.read.parquet(tables.decisions).collect()}
    # client 1.1.1.1 last came with a browser, so its stored profile is clean
    assert decided == {1: "block", 2: "allow", 4: "allow", 5: "allow", 6: "allow"}
    events = event_log.read_events(spark, tables.events)
    assert sorted(r.event_id for r in events.collect()) == [1, 4, 5, 6]
    stored = {r.ip: r.ua_is_known_bot for r in store.read_profiles(spark, tables.profiles).collect()}
    assert stored == {"1.1.1.1": 0, "2.2.2.2": 0}
    live_alerts = store.read_active_alerts(spark, tables.alerts, F.lit(300)).collect()
    assert [(r.ip, r.flagged_at) for r in live_alerts] == [("1.1.1.1", 100)]


def test_alerts_are_seen_with_the_batch_that_flags(spark, folder):
    profiles = spark.createDataFrame([("a", 42)], "ip string, req_count long")
    keep = alerts.alert_handler(folder + "/alerts", profiles)
    flags = lambda *rows: spark.createDataFrame(rows, "ip string, flagged_at long, reason string")
    now = lambda t: {(r.ip, r.flagged_at, r.reason, r.request_count_at_flag) for r in
                     store.read_active_alerts(spark, folder + "/alerts", F.lit(t)).collect()}
    keep(flags(("a", 100, "r1"), ("a", 90, "r0"), ("b", 200, "r")), 0)
    assert now(200) == {("a", 100, "r1", 42), ("b", 200, "r", 0)}
    for _ in range(2):
        keep(flags(("a", 3000, "r2")), 1)
    assert now(3750) == {("a", 3000, "r2", 42), ("b", 200, "r", 0)} and now(3800) == {("a", 3000, "r2", 42)}
    assert now(6600) == set()


def test_late_requests_miss_closed_windows_only(spark, folder):
    def arrive(name, rows):
        spark.createDataFrame(rows, "event_id long, s long, is_bot int").selectExpr(
            "event_id", "timestamp_seconds(s) AS ts", "is_bot").coalesce(1).write.mode("append").parquet(folder + "/in")

    def consume():
        stream = spark.readStream.schema("event_id long, ts timestamp, is_bot int").parquet(folder + "/in")
        run.finish(run.to_table(monitors.throughput(stream), folder + "/out", folder + "/cp", once=True))
        return {r.bucket.minute: (r.requests, r.bots) for r in spark.read.parquet(folder + "/out").collect()}

    arrive("a", [(1, 10, 1), (2, 20, 0), (3, 1300, 1)])
    assert consume() == {0: (2, 1)}  # 1300 s minus 10 minutes closes the first windows
    arrive("b", [(4, 30, 1), (5, 1310, 0), (6, 5000, 0)])
    assert consume() == {0: (2, 1), 20: (2, 1)}  # the late request changed nothing


def test_batch_and_stream_features_share_their_partials(spark):
    log = random_log(12)
    df = spark.createDataFrame(log, SCHEMA)
    assert features.partials(df).seconds.agg(F.sum("requests")).first()[0] == sum(1 for r in log if r[1])


def test_tiered_query_streams_a_long_log_in_as_many_batches_as_a_short_one(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cells.FeatureCells, "add", lambda self, batch, batch_id: seen.append(batch_id))
    monkeypatch.setattr(cells.FeatureCells, "features", lambda self: self.spark.range(0))
    for sf in ("0.001", "0.01"):
        queries.QUERIES["stream_features_tiered"](spark, f"/root/testdata/sf{sf}")
    assert seen == 2 * list(range(10))
