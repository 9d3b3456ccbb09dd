"""Sessions and features against a brute-force reading of the rules."""

import math
import random
import statistics
from collections import Counter, defaultdict

import pytest

from crawlsight.functions.useragent import BROWSER_TOKENS, KNOWN_BOT_TOKENS
from crawlsight.operators import features, sessions

SCHEMA = ("event_id long, ip string, epoch_s long, useragent string, path string, "
          "status_code int, bytes_sent long, gt_is_robot int")


def random_log(seed, rows=600, hot=True):
    rnd = random.Random(seed)
    agents = ["Googlebot/2", "Chrome/1", "-", "", None, "curl/8", "Lynx"]
    log = []
    for i in range(rows):
        ip = rnd.choice(["a", "b", "c", "d", "e", "f", "", None])
        t = rnd.choice([rnd.randrange(0, 40000), rnd.randrange(0, 200), 1800 * rnd.randrange(0, 20), 3599, 3600])
        if hot and i % 3 == 0:
            ip, t = "hot", rnd.randrange(0, 50)
        log.append((i, ip, 1_700_000_000 + t, rnd.choice(agents), rnd.choice(["/x", "/y", "/z", None]),
                    rnd.choice([200, 404, 500, None]), rnd.choice([None, 10, 999]), rnd.choice([None] * 30 + [1, 0])))
    return log


def by_client(log):
    clients = defaultdict(list)
    for row in log:
        if row[1]:
            clients[row[1]].append(row)
    return {ip: sorted(rows, key=lambda r: (r[2], r[0])) for ip, rows in clients.items()}


def brute_sessions(rows, gap=1800):
    out, index, prev = [], 0, None
    for r in rows:
        step = None if prev is None else r[2] - prev
        index += step is None or step > gap
        out.append((r[0], None if step is None else float(step), index))
        prev = r[2]
    return out


def brute_features(rows):
    times = [r[2] for r in rows]
    gaps = [b - a for a, b in zip(times, times[1:])]
    n = len(rows)
    sizes = [r[6] for r in rows if r[6] is not None]
    bot = lambda ua: any(t in (ua or "").lower() for t in KNOWN_BOT_TOKENS)
    web = lambda ua: any(t in (ua or "").lower() for t in BROWSER_TOKENS) and not bot(ua)
    sample = min(((r[2], r[3]) for r in rows if r[3] not in (None, "", "-")), default=(0, ""))[1]
    entropy = -sum(c / len(sample) * math.log2(c / len(sample)) for c in Counter(sample).values()) if sample else 0.0
    sessions_n = brute_sessions(rows)[-1][2]
    rate_404 = sum(r[5] == 404 for r in rows) / n
    known = int(any(bot(r[3]) for r in rows))
    truth = max((r[7] for r in rows if r[7] is not None), default=None)
    return dict(
        req_count=n, avg_interval=statistics.fmean(gaps) if gaps else 0.0,
        std_interval=statistics.stdev(gaps) if len(gaps) > 1 else 0.0,
        min_interval=float(min(gaps, default=0)),
        requests_per_hour=n / max((times[-1] - times[0]) / 3600, 1 / 3600),
        session_count=sessions_n, avg_session_length=n / sessions_n,
        unique_paths_ratio=len({r[4] for r in rows if r[4] is not None}) / n,
        error_rate=sum((r[5] or 0) >= 400 for r in rows) / n, rate_404=rate_404,
        avg_bytes=statistics.fmean(sizes) if sizes else 0.0, ua_is_known_bot=known,
        ua_is_browser=int(any(web(r[3]) for r in rows)), ua_entropy=entropy,
        is_robot=truth if truth is not None else int(known or rate_404 > 0.5))


def check_features(df, log):
    got = {r.ip: r.asDict() for r in df.collect()}
    clients = by_client(log)
    assert set(got) == set(clients)
    for ip, rows in clients.items():
        for name, value in brute_features(rows).items():
            assert got[ip][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (ip, name)


@pytest.mark.parametrize("seed", range(4))
def test_features_match_brute_force(spark, seed):
    log = random_log(seed)
    check_features(features.ip_features(spark.createDataFrame(log, SCHEMA)), log)


@pytest.mark.parametrize("seed", range(3))
def test_slices_merge_to_the_whole(spark, seed):
    log = random_log(seed + 50)
    rnd = random.Random(seed)
    cuts = [[], [], []]
    for row in log:
        cuts[rnd.randrange(3)].append(row)
    slices = [spark.createDataFrame(part, SCHEMA) for part in cuts]
    check_features(features.ip_features_merged(slices), log)


@pytest.mark.parametrize("seed", range(3))
def test_sessions_match_brute_force(spark, seed):
    log = random_log(seed + 100)
    df = spark.createDataFrame(log, SCHEMA)
    expected = sorted(x for rows in by_client(log).values() for x in brute_sessions(rows))
    got = sessions.enrich_requests(df).select("event_id", "interval", "session_index").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == expected
    intervals = sessions.request_intervals(df).select("event_id", "interval").collect()
    assert sorted(map(tuple, intervals), key=lambda r: r[0]) == [x[:2] for x in expected]
    summary = sessions.session_summary(df).collect()
    assert sum(r.requests for r in summary) == len(expected)
    assert len(summary) == sum(brute_sessions(rows)[-1][2] for rows in by_client(log).values())


@pytest.mark.parametrize("step, expected", [(1799, 1), (1800, 1), (1801, 2)])
def test_gap_limit(spark, step, expected):
    log = [(0, "a", 100, "", "/", 200, 1, None), (1, "a", 100 + step, "", "/", 200, 1, None)]
    df = spark.createDataFrame(log, SCHEMA)
    row = features.ip_features(df).first()
    assert (row.session_count, row.std_interval, row.avg_interval) == (expected, 0.0, float(step))
    assert sessions.session_summary(df).count() == expected


def test_single_request(spark):
    row = features.ip_features(spark.createDataFrame([(0, "a", 0, None, None, None, None, None)], SCHEMA)).first()
    assert (row.req_count, row.avg_interval, row.min_interval, row.requests_per_hour) == (1, 0.0, 0.0, 3600.0)
    assert (row.avg_bytes, row.unique_paths_ratio, row.ua_entropy, row.first_seen) == (0.0, 0.0, 0.0, "1970-01-01T00:00:00")


def test_empty_log(spark):
    assert features.ip_features(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deviation_of_long_spans_is_exact(spark):
    times = [0, 10 ** 8, 2 * 10 ** 8 + 1, 3 * 10 ** 8 + 1, 4 * 10 ** 8 + 3]
    log = [(i, "a", t, "", "/", 200, 1, None) for i, t in enumerate(times)]
    gaps = [b - a for a, b in zip(times, times[1:])]
    row = features.ip_features(spark.createDataFrame(log, SCHEMA)).first()
    assert row.std_interval == pytest.approx(statistics.stdev(gaps), rel=1e-12)


def test_plan_has_no_per_request_python_cross_join_or_wide_read(spark):
    from crawlsight.sources import sample_log

    log = sample_log.access_log(sample_log.read_events(spark, "/root/testdata/sf0.001"))
    plan = features.ip_features(log)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.count("FileScan") == 3 and "SortAggregate(key=[ip" in plan
    # the raw log is only reduced by hash aggregation
    assert all("SortAggregate" not in line or "first_s" in line for line in plan.splitlines())
