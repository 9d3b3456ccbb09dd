"""Address expressions: validity, subnets, network keys, caller address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

SESSION_BUCKET_SECONDS = 1800

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H16 = r"[0-9A-Fa-f]{1,4}"
_TAIL32 = rf"(?:{_H16}:{_H16}|{_QUAD})"


def _ipv6_pattern() -> str:
    """The RFC 3986 forms: eight groups, or '::' in place of at least one group."""
    forms = [rf"(?:{_H16}:){{6}}{_TAIL32}", rf"::(?:{_H16}:){{5}}{_TAIL32}"]
    for after in range(4, -1, -1):
        before = 4 - after
        head = rf"(?:(?:{_H16}:){{0,{before}}}{_H16})?"
        middle = rf"(?:{_H16}:){{{after}}}" if after else ""
        forms.append(rf"{head}::{middle}{_TAIL32}")
    forms.append(rf"(?:(?:{_H16}:){{0,5}}{_H16})?::{_H16}")
    forms.append(rf"(?:(?:{_H16}:){{0,6}}{_H16})?::")
    return "(?:" + "|".join(forms) + ")"


IPV4_PATTERN = rf"\A{_QUAD}\z"
IPV6_PATTERN = rf"\A{_ipv6_pattern()}(?:%[^%/]+)?\z"
# Anonymised addresses keep a dotted numeric form of three or four parts.
PSEUDO_IP_PATTERN = r"\A\d{1,5}(\.\d{1,5}){2,3}\z"


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4_PATTERN), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV6_PATTERN), F.lit(False))


def is_client_address(ip: Column) -> Column:
    """A real address or the anonymised dotted form; outer blanks are ignored."""
    bare = F.trim(ip)
    return is_ipv4(bare) | F.coalesce(bare.rlike(PSEUDO_IP_PATTERN), F.lit(False)) | is_ipv6(bare)


def subnet24(ip: Column) -> Column:
    """`a.b.c.0/24` when the first three dotted parts are digits, else ''."""
    head = F.regexp_extract(ip, r"^(\d+\.\d+\.\d+)(?:\.|$)", 1)
    return F.coalesce(F.when(head != "", F.concat(head, F.lit(".0/24"))), F.lit(""))


def rate_key(ip: Column) -> Column:
    """The subnet, or the address itself where it has none."""
    return F.coalesce(F.nullif(subnet24(ip), F.lit("")), ip)


def caller_address(forwarded_for: Column, peer: Column) -> Column:
    """First hop of a forwarded-for list, else the peer, else 'unknown'."""
    first_hop = F.when(forwarded_for != "", F.trim(F.split_part(forwarded_for, F.lit(","), F.lit(1))))
    return F.coalesce(first_hop, peer, F.lit("unknown"))


def session_bucket_id(ip: Column, epoch: Column) -> Column:
    """MD5 of the address and the half-hour number."""
    bucket = F.floor(epoch / F.lit(float(SESSION_BUCKET_SECONDS))).cast("bigint")
    return F.md5(F.concat(ip, bucket.cast("string")).cast("binary"))


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a number; NULL for anything else."""
    return F.aggregate(F.split(F.when(is_ipv4(ip), ip), r"\."), F.lit(0).cast("bigint"),
                       lambda acc, part: acc * 256 + part.cast("bigint"))


def _with_hex_tail(ip: Column) -> Column:
    """A dotted-quad tail written as two groups of hex digits."""
    digits = F.lpad(F.hex(ipv4_number(F.regexp_extract(ip, rf"({_QUAD})\z", 1))), 8, "0")
    tail = bind(digits, lambda d: F.concat(F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))
    return F.when(F.contains(ip, F.lit(".")),
                  F.concat(F.regexp_replace(ip, rf"{_QUAD}\z", ""), tail)).otherwise(ip)


def _groups(side: Column) -> Column:
    return F.transform(F.filter(F.split(side, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text as 32 hex digits; NULL for anything else."""
    bare = _with_hex_tail(F.split_part(F.when(is_ipv6(ip), ip), F.lit("%"), F.lit(1)))
    sides = bind(bare, lambda t: F.transform(F.split(t, "::"), _groups))
    filled = bind(sides, lambda s: F.array_join(F.concat(
        s[0],
        F.array_repeat(F.lit("0000"), F.lit(8) - F.size(F.flatten(s))),
        F.coalesce(F.get(s, F.lit(1)), F.array().cast("array<string>"))), ""))
    return F.lower(filled)


def ipv4_network_key(number: Column, prefix_len: Column) -> Column:
    """Text that two IPv4 numbers share exactly when their first `prefix_len` bits agree."""
    masked = F.call_function("shiftright", number, (F.lit(32) - prefix_len).cast("int"))
    return F.concat(F.lit("4/"), prefix_len.cast("string"), F.lit("/"), masked.cast("string"))


def ipv6_network_key(digits: Column, prefix_len: Column) -> Column:
    """The same for 32 hex digits."""
    whole = F.floor(prefix_len / F.lit(4)).cast("int")
    rest = (prefix_len - whole * 4).cast("int")
    nibble = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).try_cast("int")
    masked = F.coalesce(F.call_function("shiftright", nibble, F.lit(4) - rest), F.lit(0))
    return F.concat(F.lit("6/"), prefix_len.cast("string"), F.lit("/"),
                    F.substr(digits, F.lit(1), whole), F.lit("/"), masked.cast("string"))
