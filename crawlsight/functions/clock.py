"""Time expressions over epoch seconds and timestamps (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_instant(text: Column) -> Column:
    """ISO-8601 text to timestamp, NULL where it does not parse."""
    return F.try_to_timestamp(text)


def floor_to(epoch: Column, seconds: int) -> Column:
    """Start of the bucket of `seconds` that holds the epoch second."""
    return (F.floor(epoch / F.lit(float(seconds))) * seconds).cast("bigint")


def as_instant(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def weekday_from_sunday(ts: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(ts) - 1


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
