"""Attribute filters as one reusable Column, and the domains of the parameters."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RADIUS_M = 2_000_000.0
MAX_LIMIT = 1000
MAX_GROUPS = 500
#: Accepted ways to write a time.
TIME_FORMATS = ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M")


def check_range(name: str, value: float, low: float, high: float) -> float:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low:g} and {high:g}, not {value:g}")
    return value


def check_page(limit: int | None, skip: int, most: int = MAX_LIMIT) -> None:
    if limit is not None:
        check_range("limit", limit, 1, most)
    check_range("skip", skip, 0, float("inf"))


def parse_time(value: str | datetime) -> datetime:
    """A time without zone; one with a zone is taken as UTC."""
    if isinstance(value, datetime):
        return value if value.tzinfo is None else value.astimezone(timezone.utc).replace(tzinfo=None)
    for form in TIME_FORMATS:
        try:
            return datetime.strptime(value, form)
        except ValueError:
            continue
    raise ValueError(f"{value!r} is not a time in one of {', '.join(TIME_FORMATS)}")


def _time(value: str | datetime) -> Column:
    """As text first: a datetime would become an instant of the process's zone and be shown in the session's."""
    return F.lit(parse_time(value).isoformat(sep=" ")).cast("timestamp_ntz")


def attribute_filter(
    severity: Sequence[int] | None = None,
    min_severity: int | None = None,
    state: str | None = None,
    city: str | None = None,
    weather: str | None = None,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    year: int | None = None,
    hour_from: int | None = None,
    hour_to: int | None = None,
) -> Column:
    """The conjunction of what is given; true when nothing is.

    A list of severities wins over a minimum. Text is literal and, but for the state, matched in any
    case. An hour band whose start is after its end passes midnight; it needs both ends.
    """
    parts: list[Column] = []
    if severity:
        for s in severity:
            check_range("severity", s, 1, 4)
        parts.append(F.col("severity").isin(*severity))
    elif min_severity is not None:
        parts.append(F.col("severity") >= int(check_range("min_severity", min_severity, 1, 4)))
    if state:
        parts.append(F.col("state") == state.upper())
    if city:
        parts.append(F.lower("city") == city.lower())
    if weather:
        parts.append(F.lower("weather").contains(weather.lower()))
    if start is not None:
        parts.append(F.col("start_time") >= _time(start))
    if end is not None:
        parts.append(F.col("start_time") <= _time(end))
    if year is not None:
        parts.append(F.col("year") == int(check_range("year", year, 1900, 2100)))
    if hour_from is not None and hour_to is not None:
        check_range("hour_from", hour_from, 0, 23)
        check_range("hour_to", hour_to, 0, 23)
        h = F.col("hour")
        parts.append(h.between(hour_from, hour_to) if hour_from <= hour_to else (h >= hour_from) | (h <= hour_to))
    return functools.reduce(operator.and_, parts, F.lit(True))
