"""User-agent expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

# User-agent tokens of known automation and of browsers.
KNOWN_BOT_TOKENS = (
    "bot", "crawl", "spider", "slurp", "googlebot", "bingbot", "baiduspider", "yandex",
    "duckduckbot", "ahrefs", "semrush", "mj12bot", "dotbot", "petalbot", "applebot",
    "facebookexternalhit", "ia_archiver", "icc-crawler", "curl", "wget", "python-requests",
    "python-urllib", "scrapy", "httpclient", "java/", "go-http-client", "libwww", "okhttp",
    "headlesschrome", "phantomjs",
)
BROWSER_TOKENS = ("chrome", "firefox", "safari", "edg", "opera", "msie", "trident")


def _mentions(ua: Column, tokens: tuple[str, ...]) -> Column:
    """Contains any token, whatever the case.

    Plain substring search is several times faster than one pattern of all tokens, and a
    token that holds another one adds nothing.
    """
    needed = [t for t in tokens if not any(o != t and o in t for o in tokens)]
    found = bind(F.lower(ua), lambda low: reduce(or_, [low.contains(t) for t in needed]))
    return F.coalesce(found, F.lit(False))


def is_known_bot(ua: Column) -> Column:
    return _mentions(ua, KNOWN_BOT_TOKENS)


def is_browser(ua: Column) -> Column:
    """A browser token and no automation token."""
    return _mentions(ua, BROWSER_TOKENS) & ~is_known_bot(ua)


def is_usable(ua: Column) -> Column:
    """Says something about the client: not missing, empty or the '-' placeholder."""
    return F.coalesce(~ua.isin("", "-"), F.lit(False))


def char_entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters; 0 for missing or empty text.

    Costs far more than the token tests: take it per client or per distinct user agent.
    """
    size = F.length(text)
    shares = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size,
    )
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(size > 0, bits).otherwise(F.lit(0.0))
