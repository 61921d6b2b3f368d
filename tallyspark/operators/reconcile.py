"""Sums that are declared, and what is left between them and what was printed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import sum_known
from .identity import MOST_TERMS


class NotAdditive(ValueError):
    """A sum over a measure for which no scope was declared."""


class Measure:
    """A column that may be summed only within a declared scope, since figures of different kinds must not be added."""

    def __init__(self, column: str, scope: Sequence[str] | None = None):
        self.column, self.scope = column, scope

    def total(self, df: DataFrame, *by: str) -> DataFrame:
        """Sums by the declared scope at least; null where a part is missing."""
        if self.scope is None or not set(self.scope) <= set(by):
            raise NotAdditive(f"{self.column} has no sum by {by or 'the whole table'}")
        return df.groupBy(*by).agg(sum_known(F.col(self.column)).alias("total"), F.count("*").alias("n"))


def exact_total(df: DataFrame, by: Sequence[str], value: Column, name: str = "total") -> DataFrame:
    """Exact sums by group; null where a part is missing, with the number of parts."""
    return df.groupBy(*by).agg(sum_known(value).alias(name), F.count("*").alias("n_parts"), F.count(value).alias("n_known"))


def residuals(parts: DataFrame, totals: DataFrame, on: Sequence[str], part: str, total: str) -> DataFrame:
    """Totals with the sum of their parts, the signed residual and a status.

    ``explained`` if the residual is zero, ``flagged_unreviewed`` if not, ``insufficient_evidence`` if there
    are no parts or one of them or the total is missing.
    """
    summed = exact_total(parts, on, F.col(part), "part_sum")
    joined = totals.join(summed, list(on), "left").withColumn("residual", F.col("part_sum") - F.col(total))
    status = F.when(F.col("residual").isNull(), "insufficient_evidence").when(F.col("residual") == 0, "explained").otherwise("flagged_unreviewed")
    return joined.withColumn("status", status)


def equations(terms: DataFrame, values: DataFrame, by: Sequence[str] = ("equation_id",)) -> DataFrame:
    """Signed sums of ordered inputs; one row an equation.

    ``terms``: equation_id, position, input_id, coefficient. ``values``: id, value. The residual is null
    if an input is missing; ``inputs`` lists the ids in order. An equation of over a hundred inputs is an
    error, and is found by counting before any list is made.
    """
    long = terms.groupBy(*by).count().where(F.col("count") > MOST_TERMS).limit(1).collect()
    if long:
        raise ValueError(f"over {MOST_TERMS} inputs in {long[0][by[0]]}")
    joined = terms.join(values.select(F.col("id").alias("input_id"), "value"), "input_id", "left")
    signed = F.col("coefficient") * F.col("value")
    return joined.groupBy(*by).agg(
        sum_known(signed).alias("residual"), F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.transform(F.sort_array(F.collect_list(F.struct("position", "input_id"))), lambda x: x["input_id"]).alias("inputs"),
    )


def graph_faults(equations: DataFrame, records: DataFrame, graph: DataFrame) -> DataFrame:
    """``(equation_id, position, input_id, fault)``: where equations are not those that a declared graph says; the output is position 0.

    ``equations``: equation_id, kind, fiscal_year, inputs (ids in order), output. ``records``: id, key (its label), fiscal_year.
    ``graph``: kind, inputs (keys in order), output. Both are laid out by position and met there, so that an input that is missing, one too
    many, unknown, given twice, of another year, of another label, or in another's place is named. An equation of an unknown kind is one fault.
    Ids of equations and records are unique, as their gates say.
    """
    edges = graph.select("kind", F.col("inputs").alias("keys"), F.posexplode(F.concat(F.array("output"), "inputs")).alias("position", "wanted"))
    wanted = equations.select("equation_id", "kind", F.col("fiscal_year").alias("year")).join(edges, "kind", "left")
    twice = F.size(F.filter("inputs", lambda x: x == F.col("input_id"))) > 1
    given = equations.select("equation_id", F.col("fiscal_year").alias("own_year"), "inputs", F.posexplode(F.concat(F.array("output"), "inputs")).alias("position", "input_id"))
    given = given.withColumn("twice", twice).drop("inputs").join(records.select(F.col("id").alias("input_id"), "key", "fiscal_year"), "input_id", "left")
    known = wanted.where("position is not null").select("equation_id", "position", "wanted", "keys")
    met = given.join(known, ["equation_id", "position"], "full").join(wanted.where("position is null").select("equation_id", F.lit(True).alias("lost")), "equation_id", "left")
    fault = (
        F.when(F.col("lost"), F.when(F.col("position") == 0, "no graph")).when(F.col("own_year").isNull(), "missing input").when(F.col("wanted").isNull(), "extra input")
        .when(F.col("key").isNull(), "unknown record").when(F.col("twice"), "repeated input").when(~F.coalesce(F.col("fiscal_year") == F.col("own_year"), F.lit(False)), "other year")
        .when(F.col("key") != F.col("wanted"), F.when(F.array_contains("keys", F.col("key")), "swapped").otherwise("other label"))
    )
    return met.select("equation_id", "position", "input_id", fault.alias("fault")).where("fault is not null")


def full_year(rows: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Whether a group's dates are 24 different ones, two rows in each of twelve months."""
    months = rows.groupBy(*keys, F.date_trunc("month", date).alias("month")).agg(F.count("*").alias("n"), F.count_distinct(date).alias("dates"))
    return months.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum("dates").alias("n_dates"), F.count("*").alias("n_months"),
        ((F.sum("dates") == 24) & (F.count("*") == 12) & F.every(F.col("n") == 2)).alias("full_year"),
    )


def histogram(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Counts for each of the named values, zeros kept and others left out."""
    names = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return names.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, null being a value like any other."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def distinct_counts(rows: DataFrame, **keys: Sequence[str]) -> DataFrame:
    """Numbers of different tuples; as structs, so that tuples with a null count too."""
    return rows.agg(*[F.count_distinct(F.struct(*k)).alias(name) for name, k in keys.items()])


def signs(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Rows, negatives, zeros and missing values by group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(value < 0).alias("n_negative"), F.count_if(value == 0).alias("n_zero"), F.count_if(value.isNull()).alias("n_missing"))


def percent_lines(value: Column, percent: Column) -> Column:
    """A share in cents; decimals, so a half rounds away from zero, which for shares is up."""
    return F.round(value.cast("decimal(20,4)") * percent.cast("decimal(9,6)"), 2).cast("decimal(20,2)")
