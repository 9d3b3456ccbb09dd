import json

import pytest
from pyspark.sql import functions as F

from crawlsight.operators import features, profiles, rollups, scoring
from crawlsight.plans import jobs, views
from crawlsight.sources import (event_log, exports, features as feature_table, groundtruth, logs,
                                metrics, profiles as store, sample_log)

SF = "/root/testdata/sf0.001"


def write(path, text):
    with open(path, "w") as out:
        out.write(text)


RECORDS = [
    {"ip": "1.2.3.4", "timestamp": "2018-02-28T22:00:01.000Z", "useragent": None, "path": "/a",
     "method": "GET", "status_code": 200, "bytes_sent": "17"},
    {"ip": "1.2.3.4", "timestamp": "nonsense", "path": "/b"},
    {"ip": None, "timestamp": "2018-02-28T22:00:01Z"},
    {"ip": "", "timestamp": "2018-02-28T22:00:01Z"},
    {"ip": "5.6.7.8", "timestamp": "2018-03-01T00:00:00+02:00", "status_code": "oops", "bytes_sent": 1.5},
]


@pytest.mark.parametrize("layout", ["canonical", None])
def test_ndjson(spark, folder, layout):
    write(f"{folder}/log.json", "\n".join(map(json.dumps, RECORDS)) + "\n{broken\n")
    rows = {r.ip: r for r in logs.read_logs(spark, f"{folder}/log.json", layout).collect()}
    assert set(rows) == {"1.2.3.4", "5.6.7.8"}
    assert (rows["1.2.3.4"].status_code, rows["1.2.3.4"].bytes_sent, rows["1.2.3.4"].useragent) == (200, 17, "")
    assert rows["5.6.7.8"].status_code is None and rows["5.6.7.8"].bytes_sent is None
    assert [str(rows[ip].ts) for ip in sorted(rows)] == ["2018-02-28 22:00:01", "2018-02-28 22:00:00"]


def test_aliases_first_present_wins(spark):
    df = spark.createDataFrame([("1.1.1.1", "2020-01-01T00:00:00Z", None, "/r", "404", "5", "1")],
                               "ip string, timestamp string, path string, resource string, response string, bytes string, robot string")
    row = logs.canonical(df).first()
    assert (row.path, row.status_code, row.bytes_sent, row.gt_is_robot) == (None, 404, 5, 1)


DUMP = """{
  "1": {"ip": "1.1.1.1", "timestamp": "2018-02-28T22:00:01.000Z", "useragent": "a{b}", "resource": "/x", "method": "GET", "response": " 200 ", "bytes": "abc"},

  "2": {"ip": "2.2.2.2", "timestamp": "2018-02-28T22:00:02.000Z", "useragent": "u", "resource": "/y", "method": "GET", "response": 404, "bytes": 12},
  "3": {"ip": "3.3.3.3", "timestamp": "2018-02-28
  no record here
  "4": {"ip": "4.4.4.4"}
}
"""


def test_dump(spark, folder):
    write(f"{folder}/dump.json", DUMP)
    rows = {r.ip: r for r in logs.read_dump(spark, f"{folder}/dump.json").collect()}
    assert set(rows) == {"1.1.1.1", "2.2.2.2", "4.4.4.4"}
    assert (rows["1.1.1.1"].status_code, rows["1.1.1.1"].bytes_sent, rows["1.1.1.1"].useragent) == (200, None, "a{b}")
    assert (rows["2.2.2.2"].status_code, rows["2.2.2.2"].bytes_sent, rows["2.2.2.2"].path) == (404, 12, "/y")
    logs.write_ndjson(logs.read_dump(spark, f"{folder}/dump.json"), f"{folder}/ndjson")
    assert logs.read_logs(spark, f"{folder}/ndjson").count() == 2


def test_feature_table_falls_back(spark, folder):
    table = features.ip_features(sample_log.access_log(sample_log.read_events(spark, SF)))
    parquet, csv = f"{folder}/f.parquet", f"{folder}/f.csv"
    assert feature_table.load_features(spark, parquet, csv).count() == 0
    feature_table.write_features_csv(table, csv)
    from_csv = feature_table.load_features(spark, parquet, csv)
    assert from_csv.schema == feature_table.load_features(spark, "/nowhere").schema
    assert from_csv.drop("date").exceptAll(feature_table.typed(table).drop("date")).count() == 0
    feature_table.write_features(table, parquet)
    from_parquet = feature_table.load_features(spark, parquet, csv)
    assert from_parquet.exceptAll(feature_table.typed(table)).count() == 0
    pruned = from_parquet.filter("date = '2024-01-01'").select("ip")
    assert "PartitionFilters: [isnotnull(date" in pruned._jdf.queryExecution().executedPlan().toString()


def test_rollups_of_empty_tables(spark):
    empty = feature_table.load_features(spark, "/nowhere")
    assert tuple(rollups.overview(empty).first()) == (0, 0, 0, 0.0, 0, 0.0)
    events = spark.createDataFrame([], event_log.EVENT_LOG)
    assert rollups.event_stats(events).first().bot_ratio == 0.0
    assert rollups.events_summary(events).first().last_event_at is None
    assert rollups.dow_hour_dense(events).agg(F.sum("intensity")).first()[0] == 0.0


def test_event_log_batches_can_run_again(spark, folder):
    scored = spark.createDataFrame([(1, "1.2.3.4", 0.0, 1), (2, "::1", 90000.0, None)],
                                   "event_id long, ip string, timestamp double, is_bot int")
    for _ in range(2):
        event_log.append_events(scored, folder + "/log", 7)
    event_log.append_events(scored.filter("event_id = 1").drop("timestamp"), folder + "/log", 8)
    rows = event_log.read_events(spark, folder + "/log").orderBy("batch_id", "event_id").collect()
    assert [(r.event_id, r.cidr_block, r.is_bot) for r in rows] == [
        (1, "1.2.3.0/24", 1), (2, "", None), (1, "1.2.3.0/24", 1)]
    assert rows[2].timestamp > 1.6e9  # the time of the run


def test_profiles_keep_the_newest_known_cell(spark, folder):
    path = folder + "/profiles"
    assert store.read_profiles(spark, path).count() == 0
    first = spark.createDataFrame([("a", 1, 10, 0.5), ("a", 2, None, 0.25), ("b", 1, 5, None)],
                                  "ip string, updated_at long, req_count long, rate_404 double")
    store.write_updates(first, path, 0, written_at=100)
    second = spark.createDataFrame([("a", 1, 0.9), ("c", 1, 0.1)], "ip string, updated_at long, risk_score double")
    for _ in range(2):
        store.write_updates(second, path, 1, written_at=200)
    got = {r.ip: (r.req_count, r.rate_404, r.risk_score) for r in store.read_profiles(spark, path).collect()}
    assert got == {"a": (10, 0.25, 0.9), "b": (5, None, None), "c": (None, None, 0.1)}
    assert store.read_profiles(spark, path, without_batch=1).count() == 2
    store.compact(spark, path, folder + "/compacted")
    again = {r.ip: (r.req_count, r.rate_404, r.risk_score)
             for r in store.read_profiles(spark, folder + "/compacted").collect()}
    assert again == got
    flat = profiles.profile_lookup(profiles.as_families(store.read_profiles(spark, path)))
    assert flat.filter("ip = 'a'").first().risk_score == 0.9


def test_alerts_expire(spark, folder):
    stored = spark.createDataFrame([("a", 42)], "ip string, req_count long")
    flagged = spark.createDataFrame([("a", 1000, "r1", None), ("a", 2000, "r2", None), ("b", 1500, "r", 7),
                                     ("c", 3000, "r", None)],
                                    "ip string, flagged_at long, reason string, request_count long")
    store.write_alerts(profiles.alerts(flagged, stored), folder + "/alerts", 0)
    live = lambda now: {r.ip: (r.flagged_at, r.reason, r.request_count_at_flag) for r in
                        store.read_active_alerts(spark, folder + "/alerts", F.lit(now)).collect()}
    assert live(3000) == {"a": (2000, "r2", 42), "b": (1500, "r", 7), "c": (3000, "r", 0)}
    assert set(live(5099)) == {"a", "b", "c"} and set(live(5100)) == {"a", "c"}
    assert set(live(5600)) == {"c"} and live(6600) == {}


def test_exports(spark, folder):
    scored = spark.createDataFrame([("a", 0.9, True), ("b", 0.1, False)], "ip string, risk_score double, is_bot boolean")
    exports.write_scores_csv(scored, folder + "/csv")
    assert spark.read.option("header", True).csv(folder + "/csv").columns == ["ip", "risk_score", "is_bot"]
    exports.write_lines(scoring.flagged_ips(scored), "ip", folder + "/ips")
    assert [r.value for r in spark.read.text(folder + "/ips").collect()] == ["a"]


def test_groundtruth(spark, folder):
    write(f"{folder}/simple_features_v1.csv", "ID,A,ROBOT\n1,2,1\n2,inf,0\n3,x,0\n")
    write(f"{folder}/semantic_features_v1.csv", "ID,B,ROBOT\n1,5,0\n2,6,0\n9,1,1\n")
    rows = groundtruth.read_groundtruth(spark, folder)
    assert rows.columns == ["ID", "A", "ROBOT", "B"]
    assert sorted(map(tuple, rows.collect())) == [("1", "2", "1", "5"), ("2", "inf", "0", "6")]


def test_groundtruth_takes_the_first_match(spark, folder):
    write(f"{folder}/simple_features_b.csv", "ROBOT,A,ID\n1,9,7\n")
    write(f"{folder}/simple_features_a.csv", "ID,A,ROBOT\n1,2,1\n")
    spark.createDataFrame([(1, 5)], "ID int, B int").write.option("header", True).csv(f"{folder}/semantic_features.csv")
    assert [tuple(r) for r in groundtruth.read_groundtruth(spark, folder).collect()] == [("1", "2", "1", "5")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        groundtruth.read_feature_set(spark, folder, "other")


def test_profile_store_folds_and_reads_by_bucket(spark, folder):
    path = folder + "/profiles"
    store.fold(spark, path)
    for i in range(7):
        if i % 3 == 0:
            store.fold(spark, path, without_batch=i)
        rows = spark.createDataFrame([(f"10.0.0.{k}", 1, i * 100 + k if k != i else None, k / 10) for k in range(i, i + 4)],
                                     "ip string, updated_at long, req_count long, risk_score double")
        for _ in range(2):
            store.write_updates(rows, path, i, written_at=i)
    batches = {r.batch_id[:5] for r in spark.read.parquet(path).select("batch_id").distinct().collect()}
    assert batches == {"base-", "6"}
    newest = lambda k: max((i for i in range(7) if i < k <= i + 3), default=None)
    want = {f"10.0.0.{k}": None if newest(k) is None else newest(k) * 100 + k for k in range(10)}
    assert {r.ip: r.req_count for r in store.read_profiles(spark, path).collect()} == want
    clients = spark.createDataFrame([("10.0.0.3",), ("10.0.0.3",), ("new",)], "ip string")
    some = store.read_profiles(spark, path, clients=clients)
    assert {r.ip: r.req_count for r in some.collect()} == {"10.0.0.3": want["10.0.0.3"]}
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().executedPlan().toString()
    assert {r.ip for r in store.read_profiles(spark, path, without_batch=6).collect()} == {f"10.0.0.{k}" for k in range(9)}


def test_missing_metrics(spark):
    assert metrics.read_metrics(spark, "/nowhere").count() == 0
    assert metrics.model_comparison(metrics.read_metrics(spark, "/nowhere")).count() == 0


def test_jobs_from_dump_to_profiles(spark, folder):
    events = sample_log.access_log(sample_log.read_events(spark, SF)).select(
        F.concat(F.lit('"'), "event_id", F.lit('": '), F.to_json(F.struct(
            "ip", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "useragent",
            F.col("path").alias("resource"), "method", F.col("status_code").alias("response"),
            F.col("bytes_sent").alias("bytes"))), F.lit(",")).alias("value"))
    events.write.text(folder + "/dump")
    jobs.prepare(spark, folder + "/dump", folder + "/log")
    table = jobs.build_features(spark, folder + "/log", folder + "/tables")
    direct = features.ip_features(sample_log.access_log(sample_log.read_events(spark, SF)).drop("gt_is_robot"))
    same = [c for c in direct.columns if c != "ua_entropy"]
    assert table.select(same).exceptAll(feature_table.typed(direct).select(same)).count() == 0
    document = jobs.train(spark, folder + "/tables/features.parquet", folder + "/models", trees=3, rounds=2, folds=2)
    assert {r.model for r in metrics.model_comparison(document).collect()} == {"random_forest", "gradient_boosting"}
    assert document.first().best_model in {"random_forest", "gradient_boosting"}
    jobs.seed(spark, folder + "/tables/features.parquet", folder + "/profiles", folder + "/models")
    seeded = store.read_profiles(spark, folder + "/profiles")
    assert seeded.count() == table.count()
    assert seeded.filter("risk_score is null or model_version <> '1.0.0'").count() == 0


def test_views(spark):
    scored = sample_log.scored_requests(sample_log.read_events(spark, SF)).withColumn(
        "timestamp", F.col("epoch_s").cast("double"))
    names = views.register(spark, bot_events=event_log.event_rows(scored))
    assert "throughput_5m" in names and "overview" not in names
    assert spark.sql("select sum(requests) from throughput_5m").first()[0] == spark.sql(
        "select count(*) from bot_events").first()[0]
    assert spark.sql("select total from top_paths order by total desc limit 1").first()[0] > 0


def test_shared_agents_give_the_same_features(spark):
    log = sample_log.access_log(sample_log.read_events(spark, SF))
    stored = profiles.seed_profiles(features.ip_features(log)).drop("risk_score", "is_bot")
    cols = ["event_id", "req_count", "ua_is_known_bot", "ua_is_browser", "ua_entropy"]
    one = scoring.with_profiles(log, stored).select(cols)
    two = scoring.with_profiles(log, stored, shared_agents=True).select(cols)
    assert one.count() == two.count() and one.exceptAll(two).count() == 0
