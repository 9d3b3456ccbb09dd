"""Manifests, tiered feature cells, the versioned profile store, repeated preparation, live alerts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from crawlsight.plans import jobs
from crawlsight.sources import manifest
from crawlsight.sources.versioned_profiles import VersionedProfiles, bucket_of, parent
from crawlsight.streaming import alerts, cells, run

from test_sessions_features import SCHEMA, check_features, random_log


def test_commits_take_turns(spark, folder):
    table = manifest.Manifest(spark, folder, {"n": 0})
    other = manifest.Manifest(spark, folder, {"n": 0})
    calls = []

    def late(state):
        if not calls:  # another writer is faster
            other.commit(lambda s: {"n": s["n"] + 10})
        calls.append(state["n"])
        return {"n": state["n"] + 1}

    assert table.commit(late) == 2 and calls == [0, 10]
    assert table.read() == (2, {"n": 11}) and table.read(1) == (1, {"n": 10}) and table.read(0) == (0, {"n": 0})
    assert not [n for n in table.names("_manifest") if n.endswith(".tmp")]


def test_cells_of_many_batches_stay_few_segments(spark, folder):
    log = random_log(9)
    random.Random(3).shuffle(log)
    store = cells.FeatureCells(spark, folder, fanout=3)
    slices = [log[i::12] for i in range(12)]
    for i, rows in enumerate(slices):
        store.add(spark.createDataFrame(rows, SCHEMA).coalesce(1), i)
        levels = [s["level"] for s in store.segments()]
        assert all(levels.count(k) < 3 for k in levels)
    store.add(spark.createDataFrame(slices[11], SCHEMA), 11)  # a batch runs again
    assert len(store.segments()) <= 4
    check_features(store.features(), log)


def profiles(spark, rows):
    return spark.createDataFrame(rows, "ip string, updated_at long, req_count long, risk_score double")


def test_linear_hashing_moves_only_split_buckets(spark):
    ips = spark.range(2000).select(F.concat(F.lit("10.0."), F.col("id")).alias("ip"))
    for n in (1, 2, 3, 5, 8, 13):
        moved = ips.select(bucket_of("ip", n).alias("a"), bucket_of("ip", n + 1).alias("b")).filter("a <> b").collect()
        assert moved and {(r.a, r.b) for r in moved} == {(parent(n), n)}


def test_profile_versions(spark, folder):
    store = VersionedProfiles(spark, folder, rows=4)
    assert store.read().count() == 0 and store.fold() == 0
    want, seen = {}, {}
    for i in range(12):
        rows = [(f"10.0.0.{k}", 1, None if k == i else 100 * i + k, i / 100) for k in range(i, i + 6)]
        for _ in range(2):
            version = store.append(profiles(spark, rows), i, written_at=i)
        for ip, _, count, risk in rows:
            want[ip] = (want.get(ip, (None,))[0] if count is None else count, risk)
        seen[version] = dict(want)
        if i % 3 == 2:
            opened = store.read(version)
            store.fold()
            assert {r.ip: (r.req_count, r.risk_score) for r in opened.collect()} == want  # from the files it had opened
    read = lambda **k: {r.ip: (r.req_count, r.risk_score) for r in store.read(**k).collect()}
    assert read() == want and all(read(version=v) == then for v, then in seen.items())
    state = store.manifest.read()[1]
    assert state["n"] > 3 and not state["deltas"]
    some = spark.createDataFrame([("10.0.0.3",), ("new",)], "ip string")
    assert read(clients=some) == {"10.0.0.3": want["10.0.0.3"]}


def test_a_batch_reads_as_much_from_a_tenfold_store(spark, folder):
    read = []
    store = VersionedProfiles(spark, folder, rows=50)
    clients = spark.createDataFrame([("10.0.0.3",)], "ip string")
    for i in range(8):  # doubles its buckets at most with each fold
        rows = spark.range(200 * i, 200 * (i + 1)).select(
            F.concat(F.lit("10.0.0."), F.col("id")).alias("ip"), F.lit(1).alias("updated_at"), F.lit(1).alias("req_count"))
        store.append(rows, i, written_at=i)
        store.fold()
        read.append(store._read(store.folders(store.manifest.read()[1], clients)).count())
    assert store.read().count() == 1600 and max(read[4:]) <= 200 and read[-1] <= 150


def test_two_folds_do_not_overwrite_each_other(spark, folder, monkeypatch):
    store, other = VersionedProfiles(spark, folder), VersionedProfiles(spark, folder)
    store.append(profiles(spark, [("a", 1, 1, 0.1)]), 0, written_at=0)
    write = store._write

    def slow(*args):
        out = write(*args)
        other.fold()
        return out

    monkeypatch.setattr(store, "_write", slow)
    with pytest.raises(manifest.Conflict):
        store.fold()
    assert [(r.ip, r.req_count) for r in store.read().collect()] == [("a", 1)]


def ndjson(path, rows):
    with open(path, "w") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)


def raw(ip, stamp):
    return {"ip": ip, "timestamp": stamp, "useragent": "x", "path": "/", "method": "GET", "status_code": 200}


def test_ids_go_on_after_a_batch_of_one_request(spark, folder):
    for name, many in (("one", 1), ("two", 2)):
        ndjson(f"{folder}/{name}.ndjson", [raw("1.1.1.1", f"2024-01-01T00:00:0{k}Z") for k in range(many)])
        jobs.prepare(spark, f"{folder}/{name}.ndjson", folder + "/log", jobs.NDJSON)
    assert len({r.event_id for r in spark.read.parquet(folder + "/log").collect()}) == 3


def test_days_that_a_source_has_lost_go(spark, folder, monkeypatch):
    source, log = folder + "/a.ndjson", folder + "/log"
    days = lambda: sorted(str(r.day) for r in jobs.read_log(spark, log, jobs.PREPARED).collect())
    both = [raw("1.1.1.1", "2024-01-01T00:00:00Z"), raw("1.1.1.1", "2024-01-02T00:00:00Z")]
    ndjson(folder + "/b.ndjson", both)
    jobs.prepare(spark, folder + "/b.ndjson", log, jobs.NDJSON)
    ndjson(source, both)
    jobs.prepare(spark, source, log, jobs.NDJSON)
    assert days() == ["2024-01-01"] * 2 + ["2024-01-02"] * 2
    ndjson(source, both[:1])
    with monkeypatch.context() as m:
        m.setattr(jobs, "_remove_other_runs", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            jobs.prepare(spark, source, log, jobs.NDJSON)
    jobs.prepare(spark, source, log, jobs.NDJSON)  # the job that died runs again
    assert days() == ["2024-01-01"] * 2 + ["2024-01-02"]


def test_alert_transitions_over_batches(spark, folder):
    at = lambda s: f"2024-01-01 {s}"
    schema = "ts timestamp, ip string, is_bot int"
    batches = [[(at("00:00:10"), "a", 1), (at("00:00:50"), "a", 1), (at("00:00:20"), "b", 0), (at("00:00:30"), None, 1)],
               [(at("00:30:00"), "a", 1), (at("01:30:00"), "a", 1)],  # exactly the TTL later: still the same alert
               [(at("02:30:01"), "a", 1)], [("2100-01-01 00:00:00", "flush", 1)]]
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "ts string, ip string, is_bot int").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    out = run.replay(spark, alerts.alert_transitions(stream), folder)
    got = sorted((str(r.at)[11:], r.transition, r.hits, str(r.expires_at)[11:]) for r in out.collect() if r.ip == "a")
    assert got == [("00:00:10", "raised", 2, "01:00:50"), ("00:30:00", "extended", 3, "01:30:00"),
                   ("01:30:00", "extended", 4, "02:30:00"), ("02:30:00", "expired", 4, "02:30:00"),
                   ("02:30:01", "raised", 1, "03:30:01"), ("03:30:01", "expired", 1, "03:30:01")]
