"""Search over admitted rows: checked arguments, filters, stable orders, pages and facets."""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.frozen import freeze

#: Rows on a page (fixed values).
PAGE_SIZES = {"finder": 12, "sources": 12, "tenders": 25, "transfers": 25, "physicians": 20, "register": 20, "budget": 20, "institution": 18, "municipal": 15}


def check_date(value: str) -> str:
    """An argument that is empty or a date of the calendar; checked before any plan is made."""
    if value:
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value):
            raise ValueError(f"not a date: {value!r}")
        datetime.date.fromisoformat(value)
    return value


def check_range(low: str, high: str) -> None:
    if check_date(low) and check_date(high) and low > high:
        raise ValueError(f"the range is empty: {low} to {high}")


def check_choice(value: str, choices: Sequence[str]) -> str:
    if value and value not in choices:
        raise ValueError(f"{value!r} is none of {', '.join(choices)}")
    return value


def known_or_any(value: str, choices: Sequence[str]) -> str:
    """An argument for which unknown values mean no filter."""
    return value if value in choices else ""


def within(date: str, low: str = "", high: str = "") -> Column:
    """Inclusive bounds on a date; a null date fails as soon as a bound is given."""
    kept = F.lit(True)
    if low:
        kept = kept & F.coalesce(F.col(date) >= F.lit(low).cast("date"), F.lit(False))
    if high:
        kept = kept & F.coalesce(F.col(date) <= F.lit(high).cast("date"), F.lit(False))
    return kept


def equals(column: str, value) -> Column:
    """Equality, or no filter for an empty value."""
    return F.lit(True) if value in ("", None) else F.col(column) == F.lit(value)


def observations(rows: DataFrame, query: str = "", entity: str = "", supplier: str = "", low: str = "", high: str = "", category: str = "", categories: Sequence[str] = ("construction", "goods", "service")) -> DataFrame:
    """Awards by words, publisher, supplier, dates and category, in their stable order (SRT1).

    ``rows``: id, source_row_id, tender_id, publisher, supplier, awarded (date), categories (map of Y
    or N), amount. Arguments are checked before anything is read. Dates descend, unknown ones come last, equal ones by id.
    """
    check_range(low, high)
    check_choice(category, categories)
    kept = text.all_words(query, "tender_id", "publisher", "source_row_id", "supplier") if query else F.lit(True)
    kept = kept & text.part_of(entity, "publisher") & text.part_of(supplier, "supplier") & within("awarded", low, high)
    if category:
        kept = kept & (F.col("categories")[category] == "Y")
    return rows.where(kept).orderBy(F.desc_nulls_last("awarded"), F.asc("id"))


def payments_order(rows: DataFrame) -> DataFrame:
    """SRT2: dates descend, then program and id in dictionary order rather than by code point."""
    return rows.orderBy(F.desc("payment_date"), F.expr("program_code collate UNICODE"), F.expr("id collate UNICODE"))


def page_of(total: int, page, size: int) -> tuple[int, int]:
    """LIM1: (current page, pages); pages that are no integer count as the first, others are clamped."""
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise ValueError(f"page size {size!r}")
    pages = max(1, math.ceil(total / size))
    number = int(page) if isinstance(page, (int, float)) and not isinstance(page, bool) and math.isfinite(page) and page == int(page) and abs(page) < 2**53 else 1
    return min(pages, max(1, number)), pages


def page(ordered: DataFrame, number, size: int = 12) -> tuple[DataFrame, int, int, int]:
    """LIM1: (rows of the page, current page, pages, total) of rows in a total order.

    The rows come from the order's own limit, so no window numbers the whole table.
    """
    total = ordered.count()
    current, pages = page_of(total, number, size)
    return ordered.offset((current - 1) * size).limit(size), current, pages, total


def facets(rows: DataFrame, *columns: str, descending: bool = False) -> DataFrame:
    """SRT3: distinct known values, sorted."""
    order = [F.desc(c) if descending else F.asc(c) for c in columns]
    return rows.select(*columns).dropna().distinct().orderBy(*order)


def children(orders: DataFrame, child: str, predicate) -> DataFrame:
    """each row keeps the children for which ``predicate`` holds; rows left without any go."""
    return orders.withColumn(child, F.filter(child, predicate)).where(F.size(child) > 0)


def only_child(orders: DataFrame, child: str) -> Column:
    """M4: the child, if exactly one is visible."""
    return F.when(F.size(child) == 1, F.element_at(child, 1))


def exactly_one(rows: DataFrame, *condition: Column) -> DataFrame:
    """the one row that meets all conditions; none or several are an error, found by reading at most two."""
    found = rows
    for c in condition:
        found = found.where(c)
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"{'no' if n == 0 else 'more than one'} record")
    return found


def filed(rows: DataFrame, query: str, search: Column, **equal) -> DataFrame:
    """A text search and equalities on named columns; empty values are no filter."""
    kept = search if query else F.lit(True)
    for column, value in equal.items():
        kept = kept & equals(column, value)
    return rows.where(kept)


def number_rows(rows: DataFrame, prefix: str, *order: str) -> DataFrame:
    """Positional ids such as ``guide-007``; numbers follow the order given.

    Rows are dealt by ranges of the order into a frozen table and numbered within the ranges, to which the
    sizes of the ranges before them are added, so that no task numbers all rows.
    """
    dealt = freeze(rows.repartitionByRange(*map(F.col, order)).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))  # a row for each range
    n = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__base")
    return dealt.join(F.broadcast(sizes), "__part").withColumn("id", F.concat(F.lit(prefix), F.format_string("%03d", n))).drop("__part", "__base")
