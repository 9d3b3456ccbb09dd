import ipaddress
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlsight.functions import network, numbers, useragent, verdicts

ADDRESSES = [
    "::", "::1", "1::", "2001:db8::1", "2001:db8:0:0:1:2:3:4", "::ffff:1.2.3.4",
    "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "fe80::1%eth0", "1::2::3",
    "12345::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "::1.2.3.256", "1.2.3.4", "01.2.3.4",
    "256.1.1.1", "1.2.3", "", "abc", "FFFF::ABCD", "1:2:3:4:5:6:7:8", "::1.2.3.4", "1::1.2.3.4",
    "1:2:3:4:5:6:7:1.2.3.4", ":1", "1:", ":::", "64:ff9b::192.0.2.33", "0::0", "1.2.3.4\n",
    "fe80::1%", "255.255.255.255", "0.0.0.0", "216.244.58782",
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def evaluate(spark, values, fn, kind="string"):
    rows = column(spark, values, kind).select("x", fn(F.col("x")).alias("y")).collect()
    return {r.x: r.y for r in rows}


def test_addresses_agree_with_the_standard_grammar(spark):
    df = column(spark, ADDRESSES).select(
        "x", network.is_ipv4(F.col("x")).alias("v4"), network.is_ipv6(F.col("x")).alias("v6"),
        network.ipv4_number(F.col("x")).alias("n"), network.ipv6_hex(F.col("x")).alias("h"))
    for r in df.collect():
        try:
            ip = ipaddress.ip_address(r.x)
        except ValueError:
            ip = None
        version = ip.version if ip else None
        assert (r.v4, r.v6) == (version == 4, version == 6), r
        assert r.n == (int(ip) if version == 4 else None), r
        assert r.h == (format(int(ip), "032x") if version == 6 else None), r


def test_client_addresses(spark):
    got = evaluate(spark, ["216.244.58782", " 10.0.0.1 ", "1.2", "1.2.3.4.5", "999999.1.1", "2001:db8::1",
                           "host", "", None], network.is_client_address)
    assert [k for k, v in got.items() if v] == ["216.244.58782", " 10.0.0.1 ", "2001:db8::1"]


def test_subnets(spark):
    got = evaluate(spark, ["1.2.3.4", "216.244.58782", "1.2.3.x", "1.2.x.4", "1.2", "::1", ""], network.subnet24)
    assert got == {"1.2.3.4": "1.2.3.0/24", "216.244.58782": "216.244.58782.0/24",
                   "1.2.3.x": "1.2.3.0/24", "1.2.x.4": "", "1.2": "", "::1": "", "": ""}


def test_rate_key_and_caller(spark):
    assert evaluate(spark, ["1.2.3.4", "::1"], network.rate_key) == {"1.2.3.4": "1.2.3.0/24", "::1": "::1"}
    df = spark.createDataFrame([("a , b", "p"), ("", "p"), (None, "p"), (None, None)], "f string, p string")
    got = [r[0] for r in df.select(network.caller_address(F.col("f"), F.col("p"))).collect()]
    assert got == ["a", "p", "p", "unknown"]


def test_user_agents(spark):
    agents = {"Mozilla/5.0 (compatible; DotBot/1.2)": (1, 0), "ICC-Crawler/2.0": (1, 0),
              "Mozilla/5.0 Chrome/120 Safari/537.36": (0, 1), "python-requests/2.31.0": (1, 0),
              "Java/1.8": (1, 0), "HeadlessChrome/9": (1, 0), "Lynx/2": (0, 0), "": (0, 0)}
    df = column(spark, list(agents)).select(
        "x", useragent.is_known_bot(F.col("x")).cast("int"), useragent.is_browser(F.col("x")).cast("int"))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == agents
    none = column(spark, [None]).select(useragent.is_known_bot(F.col("x")), useragent.is_usable(F.col("x")))
    assert tuple(none.first()) == (False, False)


@pytest.mark.parametrize("text", ["a", "ab", "aab", "Mozilla/5.0 (X11)", "ÄÖ—ß", "-", ""])
def test_entropy(spark, text):
    n = len(text)
    expected = -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0
    assert evaluate(spark, [text], useragent.char_entropy)[text] == pytest.approx(expected, abs=1e-12)


def test_numbers(spark):
    got = evaluate(spark, ["12", " 7 ", "12.5", "abc", "", None], lambda c: numbers.to_number(c, "int"))
    assert got == {"12": 12, " 7 ": 7, "12.5": None, "abc": None, "": None, None: None}
    got = evaluate(spark, ["1.5", "x", "NaN", "Infinity", "-Infinity", None], numbers.model_input)
    assert got == {"1.5": 1.5, "x": 0.0, "NaN": 0.0, "Infinity": 0.0, "-Infinity": 0.0, None: 0.0}


def test_rounding_is_exact(spark):
    values = [0.125, 0.005, 0.025, 1 / 160, 3 / 160, 1.005, 2.675, 12345.675, 0.00005]
    for digits in (2, 4):
        got = evaluate(spark, values, lambda c: numbers.round_exact(c, digits), "double")
        assert got == {v: round(v, digits) for v in values}
    got = evaluate(spark, [1234567.5, 0.5, 2.5], lambda c: numbers.grouped_number(c, 0), "double")
    assert got == {v: f"{v:,.0f}" for v in (1234567.5, 0.5, 2.5)}


def test_decisions(spark):
    rows = [(0.85, True, False), (0.8499, True, False), (0.99, False, False), (1.0, True, True)]
    df = spark.createDataFrame(rows, "risk double, bot boolean, ok boolean").select(
        verdicts.decision(F.col("risk"), F.col("bot"), F.col("ok"))["decision"],
        verdicts.threat_tier(F.col("risk"), F.col("bot")))
    assert [tuple(r) for r in df.collect()] == [
        ("block", "CRITICAL"), ("throttle", "CRITICAL"), ("allow", "CRITICAL"), ("allow", "CRITICAL")]
    tiers = evaluate(spark, [0.2, 0.21, 0.4, 0.41, 0.7, 0.71], lambda c: verdicts.threat_tier(c, F.lit(False)), "double")
    assert list(tiers.values()) == ["SAFE", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]


def test_reasons_and_signals_treat_a_zero_ratio_differently(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 10, 0, 3)], """ua_is_known_bot int, rate_404 double,
        requests_per_hour double, unique_paths_ratio double, req_count int, ua_is_browser int,
        session_count int""").selectExpr("*", "0.1D error_rate", "0D ua_entropy")
    reason = df.select(verdicts.explain(
        F.col("ua_is_known_bot"), F.col("rate_404"), F.col("requests_per_hour"),
        F.col("unique_paths_ratio"), F.lit(False))).first()[0]
    assert reason == "model score below threshold"
    signals = {s.key: s for s in df.select(verdicts.signals(F.col)).first()[0]}
    assert list(signals) == ["ua", "rate_404", "rph", "upr", "err", "vol", "entropy"]
    assert (signals["upr"].value, signals["upr"].severity) == ("0.00", "danger")
    assert signals["vol"].value == "10 reqs / 3 sess"


def test_all_reasons_in_order(spark):
    df = spark.createDataFrame([(1, 0.6, 1001.0, 0.04)], "a int, b double, c double, d double")
    got = df.select(verdicts.explain(*[F.col(c) for c in "abcd"], F.lit(True))).first()[0]
    assert got == "known-bot user-agent; high 404 rate; high request rate; repetitive paths"
