"""Tolerant casts and null handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Text as double; what is no number is null."""
    return F.trim(c.cast("string")).try_cast("double")


def to_time(c: Column) -> Column:
    """Text as timestamp without zone, whole or fractional seconds; what is no time is null."""
    return F.trim(c.cast("string")).try_cast("timestamp_ntz")


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
