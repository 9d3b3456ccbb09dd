"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(value: Column, kind: str) -> Column:
    """Text or number to `kind`; NULL where it is not one."""
    return F.trim(value.cast("string")).try_cast(kind)


def model_input(value: Column) -> Column:
    """A model input: missing, non-numeric, NaN and infinite values count as 0."""
    number = to_number(value, "double")
    # NaN sorts above infinity
    return F.coalesce(F.when(F.abs(number) < float("inf"), number), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def round_exact(value: Column, digits: int) -> Column:
    """Round half-even on the exact binary value; for small result tables (goes through text)."""
    number = value.cast("double")
    text = F.replace(F.format_number(number, digits), F.lit(","), F.lit(""))
    # the formatter always drops a lone half of the last place
    half = 0.5 * 10.0 ** -digits
    return F.when(number == half, F.lit(round(half, digits))).otherwise(text.cast("double"))


def grouped_number(value: Column, digits: int) -> Column:
    """Text with thousands separators, rounded like `round_exact`."""
    return F.format_number(value.cast("double"), digits)


def bot_share(bots: Column, total: Column) -> Column:
    """Robot share at 4 decimals, 0 for nothing."""
    return F.coalesce(round_exact(ratio(bots, total), 4), F.lit(0.0))
