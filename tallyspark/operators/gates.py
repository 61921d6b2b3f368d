"""Constraint suites: a list of rules, checked together, that a table must meet before it is let in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIOLATION = "rule_id string, key string, detail string"


class Refused(ValueError):
    """A table that breaks its constraints; the message names some of the violations."""


@dataclass(frozen=True)
class Rule:
    """One constraint.

    ``row``: ``expr`` holds in every row. ``agg``: ``expr``, over aggregates, holds for the table.
    ``key``: ``columns`` tell rows apart. ``fk``: ``columns`` occur in ``parent``; ``covers``: all of ``parent`` occurs. ``group``: ``expr`` holds for each
    group of ``columns``. ``range``: the last of ``columns`` lies between the last two of a row of ``parent`` whose other columns are the same.
    An expression that is unknown counts as broken.
    """

    id: str
    kind: str
    expr: Column | None = None
    columns: tuple[str, ...] = ()
    parent: DataFrame | None = None
    parent_columns: tuple[str, ...] = ()


def row(id: str, expr: Column) -> Rule:
    return Rule(id, "row", expr)


def agg(id: str, expr: Column) -> Rule:
    return Rule(id, "agg", expr)


def key(id: str, *columns: str) -> Rule:
    return Rule(id, "key", columns=columns)


def group(id: str, expr: Column, *columns: str) -> Rule:
    return Rule(id, "group", expr, columns)


def fk(id: str, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str] | None = None) -> Rule:
    return Rule(id, "fk", columns=tuple(columns), parent=parent, parent_columns=tuple(parent_columns or columns))


def covers(id: str, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str] | None = None) -> Rule:
    return Rule(id, "covers", columns=tuple(columns), parent=parent, parent_columns=tuple(parent_columns or columns))


def within(id: str, columns: Sequence[str], value: str, ranges: DataFrame, low: str, high: str) -> Rule:
    """``value`` lies in one of the ``ranges``, ends included, of the same ``columns``; no range, or a null, breaks the rule."""
    return Rule(id, "range", columns=(*columns, value), parent=ranges, parent_columns=(*columns, low, high))


def disjoint(ranges: DataFrame, columns: Sequence[str], low: str, high: str, id: str = "id") -> DataFrame:
    """The ranges that are none (an end is null, or the low one is above the high one) or that start before an earlier one of the same ``columns`` ends.

    Earlier is by low end, high end and ``id``; ends are part of a range; what is no range reaches nowhere. A running maximum in order of the low end, so no pair is made.
    """
    before = Window.partitionBy(*columns).orderBy(F.col(low), F.col(high), F.col(id)).rowsBetween(Window.unboundedPreceding, -1)
    name = "__reached"
    while name in ranges.columns:
        name += "_"
    proper = F.coalesce(F.col(low) <= F.col(high), F.lit(False))
    reached = F.max(F.when(proper, F.col(high))).over(before)
    return ranges.withColumn(name, reached).where(~proper | F.coalesce(F.col(name) >= F.col(low), F.lit(False))).drop(name)


def named(id: str = "id") -> list[Rule]:
    """M1: identities are there, not empty, and unique."""
    return [row(f"{id}_present", F.length(F.col(id)) > 0), key(f"{id}_unique", id)]


def _text(columns: Sequence[str]) -> Column:
    """A key as text; with several columns ``|`` and ``\\`` in their values are escaped, so that keys that differ look different."""
    known = [F.col(c).cast("string") for c in columns]
    if len(known) > 1:
        known = [F.regexp_replace(k, r"([\\|])", r"\\$1") for k in known]
    return F.concat_ws("|", *[F.coalesce(k, F.lit("null")) for k in known])


def violations(df: DataFrame, rules: Sequence[Rule], id: str = "id") -> DataFrame:
    """``(rule_id, key, detail)`` for everything in ``df`` that breaks a rule.

    All row rules are tested in one scan and all table rules in one aggregation. Keys are counted as
    tuples in which null is a value like any other; a foreign key that holds a null is broken.
    """
    bad = lambda e: ~F.coalesce(e, F.lit(False))
    found = []
    rows = [r for r in rules if r.kind == "row"]
    if rows:
        broken = F.array_compact(F.array(*[F.when(bad(r.expr), F.lit(r.id)) for r in rows]))
        found.append(df.select(_text([id]).alias("key"), F.explode(broken).alias("rule_id")).select("rule_id", "key", F.lit("row").alias("detail")))
    aggs = [r for r in rules if r.kind == "agg"]
    if aggs:
        broken = F.array_compact(F.array(*[F.when(bad(r.expr), F.lit(r.id)) for r in aggs]))
        found.append(df.agg(broken.alias("b")).select(F.explode("b").alias("rule_id"), F.lit("*").alias("key"), F.lit("table").alias("detail")))
    for r in rules:
        if r.kind == "key":
            counts = df.groupBy(*r.columns).agg(F.count("*").alias("n")).where("n > 1")
            found.append(counts.select(F.lit(r.id).alias("rule_id"), _text(r.columns).alias("key"), F.concat(F.lit("rows: "), F.col("n").cast("string")).alias("detail")))
        elif r.kind == "group":
            counts = df.groupBy(*r.columns).agg(bad(r.expr).alias("bad")).where("bad")
            found.append(counts.select(F.lit(r.id).alias("rule_id"), _text(r.columns).alias("key"), F.lit("group").alias("detail")))
        elif r.kind == "fk":
            parent = r.parent.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(r.parent_columns)]).distinct()
            same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(r.columns)])
            lost = df.join(parent, same, "left_anti")
            found.append(lost.select(F.lit(r.id).alias("rule_id"), _text(r.columns).alias("key"), F.lit("no parent").alias("detail")))
        elif r.kind == "range":
            *same, value = r.columns
            ranges = r.parent.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(r.parent_columns)]).distinct()
            low, high = F.col(f"__p{len(same)}"), F.col(f"__p{len(same) + 1}")
            met = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(same)], F.col(value).between(low, high))
            found.append(df.join(ranges, met, "left_anti").select(F.lit(r.id).alias("rule_id"), _text([id]).alias("key"), F.lit("out of range").alias("detail")))
        elif r.kind == "covers":
            here = df.select(*[F.col(c).alias(p) for c, p in zip(r.columns, r.parent_columns)]).distinct()
            lost = r.parent.join(here, list(r.parent_columns), "left_anti")
            found.append(lost.select(F.lit(r.id).alias("rule_id"), _text(r.parent_columns).alias("key"), F.lit("missing").alias("detail")))
    return reduce(DataFrame.union, found) if found else df.sparkSession.createDataFrame([], VIOLATION)


def admit(df: DataFrame, rules: Sequence[Rule], id: str = "id") -> DataFrame:
    """``df``, if it breaks no rule; else :class:`Refused`. Checks run before any row is handed out."""
    some = violations(df, rules, id).limit(5).collect()
    if some:
        raise Refused("; ".join(f"{v.rule_id} at {v.key}" for v in some))
    return df


def admit_optional(parts: dict[str, tuple[DataFrame, Sequence[Rule]]], required: Sequence[str] = (), id: str = "id") -> tuple[dict[str, DataFrame], list[str]]:
    """(admitted parts, names of those left out).

    A part that breaks a rule is left out, unless it is required: then :class:`Refused` is raised.
    """
    kept, lost = {}, []
    for name, (df, rules) in parts.items():
        try:
            kept[name] = admit(df, rules, id)
        except Refused:
            if name in required:
                raise
            lost.append(name)
    return kept, lost


def profile(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(rule_id, n_rows, n_broken)`` for the row rules, from one aggregation."""
    rows = [r for r in rules if r.kind == "row"]
    counts = [F.struct(F.lit(r.id).alias("rule_id"), F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(r.expr, F.lit(False))).alias("n_broken")) for r in rows]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))
