"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row.

    The body is evaluated outside generated code, which also keeps long expressions from
    growing the generated method beyond what the JVM compiles.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
