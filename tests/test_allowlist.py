import ipaddress
import random

from crawlsight.operators import allowlist, validation
from crawlsight.streaming import run

LINES = ["# comment", "", "  127.0.0.1  ", "::1", "10.0.0.0/24", "10.0.0.77/24", "192.168.0.0/255.255.0.0",
         "172.16.0.0/0.15.255.255", "10.1.0.0/33", "10.1.0.0/x", "2001:db8::/33", "fd00::1/126", "1.2.3/24",
         "216.244.58782", "10.9.0.0/255.0.255.0", "not an ip"]


def covers(lines, ip):
    exact, nets = set(), []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        if "/" not in line:
            exact.add(line)
            continue
        try:
            nets.append(ipaddress.ip_network(line, strict=False))
        except ValueError:
            pass
    if ip in exact:
        return True
    try:
        address = ipaddress.ip_address(ip)
    except ValueError:
        return False
    return any(address in net for net in nets)


def addresses(seed=1):
    rnd = random.Random(seed)
    some = ["127.0.0.1", "::1", "0:0::1", "216.244.58782", "10.0.0.5", "10.0.1.5", "192.168.200.1",
            "172.31.0.1", "172.32.0.1", "2001:db8:7fff::1", "2001:db8:8000::1", "fd00::3", "fd00::4", "10.0.0",
            "not an ip", "10.9.1.1", ""]
    return some + [".".join(str(rnd.choice([10, 0, 1, 172, 31, 192, 168, 255])) for _ in range(4))
                   for _ in range(60)]


def test_membership_matches_the_standard_library(spark):
    allow = allowlist.parse_allowlist(spark.createDataFrame([(x,) for x in LINES], "value string"))
    rows = [(i, ip) for i, ip in enumerate(addresses() * 2)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id long, ip string")
    got = {r.id: r.allowlisted for r in allowlist.flag_allowlisted(df, allow).collect()}
    assert got == {i: covers(LINES, ip) if ip else False for i, ip in rows}
    assert allowlist.only_allowlisted(df, allow).count() == sum(got.values())
    assert allowlist.without_allowlisted(df, allow).count() == len(rows) - sum(got.values())


def test_bad_networks_are_dropped_and_entries_unique(spark):
    lines = spark.createDataFrame([(x,) for x in LINES * 2], "value string")
    entries = sorted(r.entry for r in allowlist.parse_allowlist(lines).collect())
    assert entries == sorted({"127.0.0.1", "::1", "10.0.0.0/24", "10.0.0.77/24", "192.168.0.0/255.255.0.0",
                              "172.16.0.0/0.15.255.255", "2001:db8::/33", "fd00::1/126", "216.244.58782",
                              "not an ip"})


def test_allowlist_file(spark, folder):
    with open(f"{folder}/allow.txt", "w") as out:
        out.write("\n".join(LINES))
    assert allowlist.read_allowlist(spark, f"{folder}/allow.txt").filter("kind = 'cidr'").count() == 6
    empty = spark.createDataFrame([], "value string")
    df = spark.createDataFrame([("1.2.3.4",)], "ip string")
    assert allowlist.flag_allowlisted(df, allowlist.parse_allowlist(empty)).first().allowlisted is False


def test_flagged_requests_are_not_shuffled_for_a_short_list(spark, folder):
    spark.range(1000).selectExpr("concat('10.0.0.', id % 256) AS ip", "id").write.parquet(folder + "/r")
    allow = allowlist.parse_allowlist(spark.createDataFrame([("10.0.0.0/25",)], "value string"))
    df = allowlist.flag_allowlisted(spark.read.parquet(folder + "/r"), allow)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert df.filter("allowlisted").count() == sum(1 for i in range(1000) if i % 256 < 128)


def test_request_rules(spark):
    rows = [("10.0.0.1", "/", "x"), (" 10.0.0.1", None, None), ("", "/", ""), ("x", "/", ""), (None, "/", ""),
            ("::1", "p", ""), ("::1", "", ""), ("::1", "/", "u" * 1024), ("::1", "/", "u" * 1025),
            ("::1", "/" + "p" * 2047, ""), ("::1", "/" + "p" * 2048, "")]
    df = spark.createDataFrame(rows, "ip string, path string, useragent string")
    assert [r.reject_reason is None for r in validation.validate_requests(df).collect()] == [
        True, True, False, False, False, False, True, True, False, True, False]
    assert validation.valid_requests(df).count() == 5


def test_a_stream_is_exempted_like_its_batch(spark, folder):
    lines = ["10.1.0.0/16", "10.2.3.0/24", "2001:db8::/32", "9.9.9.9", "fe80::1"]
    allow = allowlist.parse_allowlist(spark.createDataFrame([(x,) for x in lines], "value string"))
    ips = ["10.1.2.3", "10.2.3.4", "10.2.4.4", "2001:db8::5", "2001:db9::5", "9.9.9.9", "9.9.9.8", "fe80::1",
           "unknown", "", None, "10.1.2.3"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "n long, ip string")
    rows.write.parquet(folder + "/in")
    stream = allowlist.without_allowlisted(spark.readStream.schema(rows.schema).parquet(folder + "/in"), allow)
    kept = run.replay(spark, stream, folder + "/out").collect()
    assert sorted(r.n for r in kept) == [2, 4, 6, 8, 9, 10]
    assert sorted(r.n for r in allowlist.without_allowlisted(rows, allow).collect()) == [2, 4, 6, 8, 9, 10]
