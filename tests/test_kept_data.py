"""Rewrites, repeated preparation and input layouts lose and double nothing."""

import json

from pyspark.sql import functions as F

from crawlsight.plans import jobs
from crawlsight.schemas import FEATURES
from crawlsight.sources import features as feature_table, metrics


def ndjson(path, rows):
    with open(path, "w") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)


def raw(ip, second, **more):
    return {"ip": ip, "timestamp": f"2024-01-01T00:00:{second:02d}Z", "useragent": "x", "method": "GET", **more}


def test_a_client_whose_last_day_moved_stays_one_row(spark, folder):
    path = folder + "/features"
    for day, count in (("2024-01-01", 1), ("2024-01-02", 2)):
        row = spark.range(1).select(*[{"ip": F.lit("1.1.1.1"), "date": F.lit(day), "req_count": F.lit(count)}.get(
            f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FEATURES.fields])
        feature_table.write_features(row, path)
    assert [(r.ip, r.req_count) for r in feature_table.load_features(spark, path).collect()] == [("1.1.1.1", 2)]


def test_two_logs_that_share_a_day_add_up_and_a_repeat_replaces_itself(spark, folder):
    for name, ip in (("a", "1.1.1.1"), ("b", "2.2.2.2")):
        ndjson(f"{folder}/{name}.ndjson", [raw(ip, s, path="/", status_code=200) for s in range(3)])
    for name in ("a", "b", "a"):
        jobs.prepare(spark, f"{folder}/{name}.ndjson", folder + "/log", jobs.NDJSON)
    rows = spark.read.parquet(folder + "/log").collect()
    assert sorted(r.ip for r in rows) == ["1.1.1.1"] * 3 + ["2.2.2.2"] * 3
    assert len({r.event_id for r in rows}) == 6


def test_any_column_name_is_read(spark, folder):
    ndjson(folder + "/x.ndjson", [raw("1.1.1.1", 1, resource="/a", response="404", bytes="7", robot=1),
                                  raw("1.1.1.1", 2, path="/b", status=200, bytes_sent=8)])
    rows = jobs.read_log(spark, folder + "/x.ndjson").orderBy("epoch_s").collect()
    assert [(r.path, r.status_code, r.bytes_sent, r.gt_is_robot) for r in rows] == [
        ("/a", 404, 7, 1), ("/b", 200, 8, None)]


def test_a_dump_is_known_by_its_first_line(spark, folder):
    with open(folder + "/dump.json", "w") as out:
        out.write("{\n" + "".join(f'"{k}": {json.dumps(raw("1.1.1.1", k, resource="/a"))},\n' for k in range(3)) + "}\n")
    assert jobs.layout_of(spark, folder + "/dump.json") == jobs.DUMP
    assert jobs.read_log(spark, folder + "/dump.json").count() == 3


def test_version_comes_from_the_behaviour_document(spark):
    from crawlsight.schemas import METRICS

    def document(version):
        names = {"model_version": F.lit(version), "best_model": F.lit("m")}
        return spark.range(1).select(*[names.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                                       for f in METRICS.fields])

    row = metrics.headline(document("gt-1"), document("b-1")).first()
    assert (row.model_version, row.label_kind) == ("b-1", "ground truth")
    assert metrics.headline(document("gt-1"), spark.createDataFrame([], METRICS)).first().model_version == "gt-1"
