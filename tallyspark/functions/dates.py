"""Strict calendar dates, fiscal years that start in April, and instants with an offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import holds

DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
#: Instants must say their offset; a cast alone would take the session's zone.
INSTANT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def strict_date(raw: Column) -> Column:
    """Date of ``YYYY-MM-DD`` text that exists in the calendar, else null."""
    return F.when(raw.rlike(DATE), F.try_to_date(raw, "yyyy-MM-dd"))


def is_date(raw: Column) -> Column:
    return strict_date(raw).isNotNull()


def instant(raw: Column) -> Column:
    """UTC timestamp of ISO text with an offset; text without one is null."""
    return F.when(raw.rlike(INSTANT), raw.try_cast("timestamp"))


def epoch(value: Column) -> Column:
    """Timestamp of finite seconds since 1970, else null."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.timestamp_seconds(F.when(finite, value).otherwise(0.0)))


def fiscal_year(date: Column) -> Column:
    """``2024-25`` for dates from April 2024 to March 2025."""
    year = F.year(F.add_months(date, -3))
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def fiscal_bounds(label: Column) -> Column:
    """Struct of start and end dates for labels ``2025-26``, ``2021-2022`` or ``2024/25``; null unless the years follow."""
    first = F.regexp_extract(label, r"\A([0-9]{4})[-/](?:[0-9]{2}|[0-9]{4})\z", 1)
    second = F.regexp_extract(label, r"\A[0-9]{4}[-/]([0-9]{2}|[0-9]{4})\z", 1)
    year = first.try_cast("int")
    follows = (second.try_cast("int") % 100 == (year + 1) % 100) & ((F.length(second) == 2) | (second.try_cast("int") == year + 1))
    bounds = F.struct(F.make_date(year, F.lit(4), F.lit(1)).alias("start"), F.make_date(year + 1, F.lit(3), F.lit(31)).alias("end"))
    return F.when(holds(follows), bounds)


def period_holds(measure_type: Column, start: Column, end: Column, as_of: Column) -> Column:
    """Flows have no as-of date; stocks are as of the end of their period."""
    ordered = is_date(start) & is_date(end) & (start <= end)
    flow = (measure_type == "flow") & as_of.isNull()
    stock = (measure_type == "stock") & is_date(as_of) & (as_of == end)
    return holds(ordered) & (holds(flow) | holds(stock))


def in_order(longest_seconds: float, *instants: Column) -> Column:
    """Chronology: instants are known, ascend, and span at most so many seconds."""
    ascend = F.lit(True)
    for a, b in zip(instants, instants[1:]):
        ascend = ascend & (a <= b)
    span = instants[-1].cast("double") - instants[0].cast("double")
    return holds(ascend & (span <= longest_seconds))
