"""Event pages, daily sketches and the SQL functions over a made event log."""

from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from crawlsight.functions import network, useragent, verdicts
from crawlsight.gate import queries
from crawlsight.operators import rollups
from crawlsight.plans import sql_functions
from crawlsight.sources.daily_sketches import DailySketches
from crawlsight.sources.event_log import event_rows
from crawlsight.sources.event_pages import EventPages

DAY = 86_400


def events(spark, n, first=0):
    """One event an hour; every third a robot, every seventh without verdict; one client owns a third."""
    i = F.col("id")
    return spark.range(first, first + n).select(
        i.alias("event_id"), F.when(i % 3 == 1, "10.0.0.1").otherwise(F.concat(F.lit("10.1.2."), i % 50)).alias("ip"),
        (i * 3600).cast("double").alias("timestamp"), F.when(i % 11 != 5, F.concat(F.lit("/p"), i % 8)).alias("path"),
        F.lit("ua").alias("useragent"), F.round(i % 10 / 10, 2).alias("risk_score"),
        F.when(i % 7 != 6, F.when(i % 3 == 0, 1).otherwise(0)).alias("is_bot"))


def brute_page(rows, before, limit, show):
    kept = [r.event_id for r in sorted(rows, key=lambda r: -r.event_id)
            if r.event_id < before and (show == "all" or (r.is_bot == 1) == (show == "bots"))]
    return kept[:limit]


def test_pages_at_any_depth_read_few_files(spark, folder):
    log = events(spark, 4000)
    rows = log.collect()
    pages = EventPages(spark, folder, rows_per_file=20)
    pages.append(log.filter("event_id < 3000 AND event_id % 2 = 0"), "even")
    pages.append(log.filter("event_id < 3000 AND event_id % 2 = 1"), "odd")   # lies between the ids of the first
    pages.append(log.filter("event_id >= 3000"), "late")
    total = pages.files().count()
    for before, limit, show in [(5000, 7, "all"), (2999, 25, "humans"), (1503, 12, "bots"), (40, 30, "all"), (5, 12, "bots"), (0, 5, "all")]:
        assert [r.event_id for r in pages.page(before, limit, show).collect()] == brute_page(rows, before, limit, show)
        assert len(pages.files_of_page(before, limit, show)) < total / 10
    assert pages.page(limit=3).first().event_id == 3999
    assert sorted(r.event_id for r in pages.since(3990).collect()) == list(range(3991, 4000))
    pages.compact()
    pages.append(log.filter("event_id < 100"), "even")  # is in the clustered batches already
    assert [r.event_id for r in pages.page(2999, 25, "humans").collect()] == brute_page(rows, 2999, 25, "humans")
    assert pages.since(-1).count() == 4000


def test_pages_of_nothing_and_of_a_repeated_batch(spark, folder):
    pages = EventPages(spark, folder)
    assert pages.page(10).count() == 0 and pages.since(0).count() == 0
    log = events(spark, 50)
    pages.append(log, 1)
    reader = pages.page(limit=60)                                  # opened before the batch is replaced
    pages.append(log.filter("event_id < 10").unionByName(log.limit(1).withColumn("event_id", F.lit(None).cast("long"))), 1)
    assert reader.count() == 50
    assert [r.event_id for r in pages.page(limit=60).collect()] == list(range(9, -1, -1))


def test_sketches_of_a_range(spark, folder):
    log = events(spark, 2400)  # 100 days
    store = DailySketches(spark, folder)
    for batch in range(3):
        store.add(log.filter(F.pmod("event_id", F.lit(3)) == batch), batch)
    store.add(log.filter("event_id % 3 = 2"), 2)  # again
    first, last = date(1970, 1, 11), date(1970, 3, 1)
    part = log.filter((F.col("timestamp") >= 10 * DAY) & (F.col("timestamp") < 60 * DAY))
    exact, paths = rollups.events_summary(part).first(), rollups.top_paths(part, 5).collect()
    for step in range(2):
        mine = store.summary(first, last).first()
        assert [mine[c] for c in ("total_events", "bot_events", "human_events", "bot_ratio", "last_event_at")] == [
            exact[c] for c in ("total_events", "bot_events", "human_events", "bot_ratio", "last_event_at")]
        assert abs(mine.unique_ips - exact.unique_ips) <= 0.05 * exact.unique_ips
        assert mine.unique_paths == exact.unique_paths  # few values are counted exactly
        assert store.top_paths(first, last, 5).collect() == paths
        if not step:
            store.compact()
            assert store.rows().filter("event_date = '1970-01-11'").count() <= 6  # three verdicts, two segments
    assert store.summary(date(2000, 1, 1)).first().total_events == 0
    assert store.summary().first().total_events == 2400


@pytest.fixture
def sql(spark):
    event_rows(events(spark, 900)).createOrReplaceTempView("bot_events")
    names = sql_functions.register(spark)
    yield spark
    for name in names:
        spark.sql(f"DROP TEMPORARY FUNCTION {name}")
    spark.catalog.dropTempView("bot_events")


def test_reports_equal_the_rollups_at_other_arguments(sql):
    log = sql.table("bot_events")
    same = lambda call, df: sorted(map(tuple, sql.sql(f"SELECT * FROM {call}").collect()), key=repr) == sorted(
        map(tuple, df.collect()), key=repr)
    assert same("report_top_paths(3)", rollups.top_paths(log, 3))
    assert same("report_subnets(1)", rollups.cidr_activity(log, 1))
    assert same("report_flagged(max_rows => 4)", rollups.top_flagged_ips(log, 4))
    assert same("report_recent(9, 500)", rollups.recent_events(log.filter("event_id < 500"), 9))
    assert same("report_recent()", rollups.recent_events(log))
    assert same("report_timeseries(7200)", rollups.events_timeseries(log, 7200))
    assert same("report_throughput(86400)", rollups.throughput(log, 86_400))
    assert same("report_risk_bins(4)", rollups.risk_histogram(log, 4))
    assert same("report_over_limit(0)", rollups.rate_limit_violations(log, F.col("ip"), 0))


def test_a_top_report_keeps_its_limit_in_every_task(sql):
    plan = sql.sql("SELECT * FROM report_top_paths(3)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=3" in plan


def test_expressions_equal_the_column_expressions(sql):
    rows = sql.createDataFrame(
        [("10.2.3.4", "Mozilla/5.0 Chrome/1", 0, 0), ("2001:db8::1", "Googlebot", 1, 3), ("", "", 1, 20_000), (None, None, 5, 0),
         ("1.2.3", "curl/8", 1, 2)], "ip string, ua string, part long, whole long")
    rows.createOrReplaceTempView("sql_rows")
    mine = sql.sql("""SELECT is_known_bot(ua), is_browser(ua), char_entropy(ua), client_subnet(ip), rate_limit_key(ip),
        client_session(ip, 5400D), heuristic_risk(CAST(part AS INT), 0.6D), share_of(part, whole) FROM sql_rows""").collect()
    ip, ua = F.col("ip"), F.col("ua")
    theirs = rows.select(
        useragent.is_known_bot(ua), useragent.is_browser(ua), useragent.char_entropy(ua), network.subnet24(ip), network.rate_key(ip),
        network.session_bucket_id(ip, F.lit(5400.0)), verdicts.heuristic_risk(F.col("part"), F.lit(0.6)),
        rollups.bot_share(F.col("part"), F.col("whole"))).collect()
    assert [tuple(r) for r in mine] == [tuple(r) for r in theirs]


def test_queried_pages_keep_as_many_files_of_a_long_log_as_of_a_short_one(spark):
    counts = [queries.paged_log(spark, f"/root/testdata/sf{sf}").files().count() for sf in ("0.001", "0.01")]
    assert counts[0] >= 90 and counts[1] < 1.5 * counts[0]


def test_sliding_rate_without_a_hash_table_of_windows(spark):
    at = [("a", t) for t in (0, 10, 299, 300, 3299, 3300, 3599, 3600, 7300, 90000)] + [("b", 3300), ("b", 6900), (None, 5)]
    rates = rollups.sliding_rate(spark.createDataFrame([(ip, float(t)) for ip, t in at], "ip string, timestamp double"))
    counted = Counter((ip, t // 300 * 300 - 300 * k) for ip, t in at if ip for k in range(12))
    assert {(r.ip, r.s): r.requests for r in rates.withColumn("s", F.unix_seconds("window_start")).collect()} == counted
    assert rates.count() == len(counted)
    assert "Expand" not in rates._jdf.queryExecution().executedPlan().toString()
