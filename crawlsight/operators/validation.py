"""Request validation and caller resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import network

# Longest accepted texts.
MAX_USERAGENT = 1024
MAX_PATH = 2048


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add `reject_reason`, NULL for a valid request; the address is trimmed."""
    ip = F.regexp_replace("ip", r"^\s+|\s+$", "")
    reason = (
        F.when(F.coalesce(ip, F.lit("")) == "", "ip must not be empty")
        .when(~network.is_client_address(ip), "ip is not an address")
        .when(F.length("useragent") > MAX_USERAGENT, "useragent too long")
        .when(F.length("path") > MAX_PATH, "path too long")
        .when((F.col("path") != "") & ~F.startswith(F.col("path"), F.lit("/")),
              "path must start with '/'"))
    return requests.withColumn("reject_reason", reason).withColumn("ip", ip)


def valid_requests(requests: DataFrame) -> DataFrame:
    return validate_requests(requests).filter("reject_reason is null").drop("reject_reason")


def client_ip(requests: DataFrame, forwarded: str = "forwarded_for", peer: str = "ip") -> DataFrame:
    """Add `client_ip`: the first forwarded hop, else the peer."""
    return requests.withColumn("client_ip", network.caller_address(F.col(forwarded), F.col(peer)))
