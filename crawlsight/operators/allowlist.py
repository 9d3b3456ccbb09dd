"""Allowlist parsing and membership.

Membership is decided once per distinct address by an equi-join: on the text for exact
entries, on prefix length and masked address for networks, so the list may grow without a
range join or a forced broadcast. The matched addresses are written out and joined to the
requests: the planner sees their size, broadcasts a short list, so that the requests are
not shuffled, and shuffles for a long one. A stream has no distinct addresses to look up
first: it is anti-joined with the list once per prefix length in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network
from ..functions.binding import bind
from ..session import written


def _is_power_of_two(n: Column) -> Column:
    return n.bitwiseAND(n - 1) == 0


def _mask_length(mask: Column) -> Column:
    """Prefix length of a netmask, else of a hostmask; NULL for a mask with holes."""
    ones = F.bit_count(mask)
    return (F.when(_is_power_of_two(F.lit(2 ** 32) - mask), ones)
            .when(_is_power_of_two(mask + 1), F.lit(32) - ones))


def _prefix_length(suffix: Column, is_v4: Column) -> Column:
    """Prefix length of '24', '255.255.255.0' or '0.0.0.255'; NULL when it is none."""
    number = F.when(suffix.rlike(r"\A\d+\z"), suffix.try_cast("int"))
    bits = F.when(is_v4, 32).otherwise(128)
    by_mask = F.when(is_v4, bind(network.ipv4_number(suffix), _mask_length))
    return F.coalesce(F.when(number <= bits, number), by_mask).cast("int")


def _network(base: Column, suffix: Column) -> Column:
    """Struct of prefix_len and match_key; NULL when the text is no network."""
    def keyed(is_v4, length):
        v4 = bind(network.ipv4_number(base), lambda n: network.ipv4_network_key(n, length))
        v6 = bind(network.ipv6_hex(base), lambda d: network.ipv6_network_key(d, length))
        key = F.when(is_v4, v4).otherwise(v6)
        return F.when(length.isNotNull() & key.isNotNull(),
                      F.struct(length.alias("prefix_len"), key.alias("match_key")))

    return bind(network.is_ipv4(base), lambda is_v4: bind(
        _prefix_length(suffix, is_v4), lambda length: keyed(is_v4, length)))


def exact_key(ip: Column) -> Column:
    return F.concat(F.lit("="), ip)


def parse_allowlist(lines: DataFrame) -> DataFrame:
    """Entries of allowlist text (column `value`): entry, kind, prefix_len, match_key.

    Blank lines and comments are skipped, networks that do not parse are dropped, host
    bits below the prefix are ignored, entries are unique.
    """
    entry = F.col("entry")
    trimmed = F.regexp_replace("value", r"^\s+|\s+$", "")
    entries = (lines.select(trimmed.alias("entry"))
               .filter((entry != "") & ~F.startswith(entry, F.lit("#"))).distinct())
    exact = F.struct(F.lit(None).cast("int").alias("prefix_len"), exact_key(entry).alias("match_key"))
    net = _network(F.split_part(entry, F.lit("/"), F.lit(1)),
                   F.regexp_extract(entry, r"^[^/]*/(.*)$", 1))
    is_network = F.contains(entry, F.lit("/"))
    return (entries.select(entry, F.when(is_network, "cidr").otherwise("exact").alias("kind"),
                           F.when(is_network, net).otherwise(exact).alias("m"))
            .filter("m is not null").select("entry", "kind", "m.*"))


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    return parse_allowlist(spark.read.text(path))


def allowlisted_addresses(addresses: DataFrame, allowlist: DataFrame) -> DataFrame:
    """The distinct `ip` values that the allowlist covers.

    An address is expanded to its text and one key per prefix length in use, at most 33
    for IPv4 and 129 for IPv6. The anonymised dotted form matches exact entries only.
    """
    ip = F.col("ip")
    ips = addresses.select("ip").filter("ip is not null").distinct()
    used = allowlist.filter("kind = 'cidr'").agg(F.collect_set(F.struct(
        F.left("match_key", F.lit(1)).alias("family"), "prefix_len"))).scalar()
    lengths = lambda family: F.filter(
        F.col("used"), lambda n: n["family"] == family)
    v4_keys = bind(network.ipv4_number(ip), lambda number: F.transform(
        lengths("4"), lambda n: network.ipv4_network_key(number, n["prefix_len"])))
    v6_keys = bind(network.ipv6_hex(ip), lambda digits: F.transform(
        lengths("6"), lambda n: network.ipv6_network_key(digits, n["prefix_len"])))
    networks = (F.when(network.is_ipv4(ip), v4_keys).when(network.is_ipv6(ip), v6_keys)
                .otherwise(F.array().cast("array<string>")))
    keys = F.concat(F.array(exact_key(ip)), networks)
    return (ips.withColumn("used", used).select("ip", F.explode(keys).alias("match_key"))
            .join(allowlist.select("match_key"), "match_key", "left_semi")
            .select("ip").distinct())


def _trusted(requests: DataFrame, allowlist: DataFrame) -> DataFrame:
    return written(allowlisted_addresses(requests, allowlist), "allowlisted")


def flag_allowlisted(requests: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Add the boolean `allowlisted`."""
    trusted = _trusted(requests, allowlist).withColumn("_trusted", F.lit(True))
    return (requests.join(trusted, "ip", "left")
            .withColumn("allowlisted", F.coalesce("_trusted", F.lit(False))).drop("_trusted"))


def _stream_without(requests: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Anti-joins of a stream with the exact entries and the networks of each prefix length."""
    ip, key = F.col("ip"), F.col("match_key")
    entries = written(allowlist.select("kind", "prefix_len", "match_key").distinct(), "allowlist")
    networks = entries.filter("kind = 'cidr'").withColumn("family", F.left(key, F.lit(1)))
    lengths = networks.select("family", "prefix_len").distinct().collect()  # 162 pairs at most
    rest = requests.join(entries.filter("kind = 'exact'").select("match_key"),
                         exact_key(ip) == key, "left_anti")
    for family, length in sorted(map(tuple, lengths)):
        v4 = family == "4"
        number = network.ipv4_number(ip) if v4 else network.ipv6_hex(ip)
        network_key = network.ipv4_network_key if v4 else network.ipv6_network_key
        fits = network.is_ipv4(ip) if v4 else ~network.is_ipv4(ip) & network.is_ipv6(ip)
        same = networks.filter((F.col("family") == family) & (F.col("prefix_len") == length))
        rest = rest.join(same.select("match_key"),
                         F.when(fits, network_key(number, F.lit(length))) == key, "left_anti")
    return rest


def without_allowlisted(requests: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Requests of other addresses; `requests` may be a stream."""
    if requests.isStreaming:
        return _stream_without(requests, allowlist)
    return requests.join(_trusted(requests, allowlist), "ip", "left_anti")


def only_allowlisted(requests: DataFrame, allowlist: DataFrame) -> DataFrame:
    return requests.join(_trusted(requests, allowlist), "ip", "left_semi")
