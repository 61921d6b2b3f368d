"""A research seed as sources, evidence and facts. What the composite ids do not say the whole seed is refused for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import safe_url
from .gates import Rule, admit, fk, key, row

#: Values of an inventory row, and the id of a research observation: stage, fiscal year, measure (fixed values).
INVENTORY_VALUES = 12
CANDIDATE = r"\A(.+?)-(202[56]-2[67])-(.+)"
#: Words that ids have for stages, and the stages that there are (fixed values).
STAGE_WORDS = {"original": "original_estimate", "amended": "amended_estimate", "capital": "capital_plan", "actual": "audited_actual"}
STAGES = ("original_estimate", "amended_estimate", "capital_plan", "adjusted_estimate", "audited_actual")
#: Dollars in a unit; the measure that is a stock; the year that ids name, and the one that all others are taken for (fixed values).
UNITS = {"CAD_thousands": 1_000, "CAD_millions": 1_000_000}
STOCK, NEW_YEAR, OLD_YEAR = "net-debt", "2026-27", "2025-26"
#: Accounting basis and reporting perimeter: of the old year, of capital plans, of other estimates (fixed values).
BASES = ("consolidated_statement_accrual", "capital_funding_plan", "budget_estimates_including_non_cash_expenses")
PERIMETERS = ("government_reporting_entity", "capital_plan_program", "general_revenue_fund_with_separate_consolidation_adjustment")
REVIEWED = "independently_verified_primary_text"
_NUMBER = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,6})?\z"


def _numbered(prefix: str, position: str) -> Column:
    """An id of at least three digits."""
    n = F.col(position).cast("string")
    return F.concat(F.lit(prefix), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")))


def inventory_rules() -> list[Rule]:
    """Rules for ``inventory(position, row, values)``: twelve values, an https address, positions that do not repeat."""
    return [row("values", F.size("values") == INVENTORY_VALUES), row("url", safe_url(F.get("values", F.lit(3))).isNotNull()), key("position", "position")]


def inventory_sources(inventory: DataFrame) -> DataFrame:
    """Sources of an inventory sheet, a row each, or :class:`Refused` for the whole. ``position`` counts from one and makes the ids."""
    v = lambda i: F.get("values", F.lit(i))
    names = {"group": 0, "jurisdiction": 1, "title": 2, "url": 3, "format": 4, "use": 5, "geography": 6, "access": 7, "priority": 8, "limitation": 9, "claim": 10, "cadence": 11}
    return admit(inventory, inventory_rules(), "position").select(_numbered("guide-", "position").alias("id"), _numbered("SI", "position").alias("inventory_id"), F.col("row").alias("inventory_row"), *[v(i).alias(n) for n, i in names.items()])


def _stage(raw: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in STAGE_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, raw), raw)


def observation_rules(documents: DataFrame) -> list[Rule]:
    """Rules for ``observations(position, candidate_id, source_id, status, unit, verified_value, source_locator)`` of a seed with ``documents(research_id, ...)``."""
    raw = F.regexp_extract("candidate_id", CANDIDATE, 1)
    return [
        row("verified", F.col("status") == REVIEWED), row("unit", F.col("unit").isin(*UNITS)), row("number", F.col("verified_value").rlike(_NUMBER)), row("observation", F.col("candidate_id").rlike(CANDIDATE)), row("stage", (raw == "") | _stage(raw).isin(*STAGES)),
        key("candidate_once", "candidate_id"), key("position", "position"), fk("source", ["source_id"], documents, ["research_id"]),
    ]


def research_facts(observations: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with their evidence, a row each, or :class:`Refused` for the whole seed.

    ``documents``: research_id, id, title, url; research ids and addresses are judged first. Stage, fiscal year and metric are read from the
    composite id; period, as-of date (of stocks alone), basis, perimeter, kind of measure and multiplier follow from them. Values stay text.
    """
    admit(documents, [key("document_once", "research_id"), row("url", safe_url(F.col("url")).isNotNull())], "research_id")
    admit(observations, observation_rules(documents), "candidate_id")
    part = lambda i: F.regexp_extract("candidate_id", CANDIDATE, i)
    year = F.when(F.contains(F.col("candidate_id"), F.lit(NEW_YEAR)), NEW_YEAR).otherwise(OLD_YEAR)
    rows = observations.withColumn("label", year).withColumn("stage", _stage(part(1))).withColumn("said", part(3)).join(documents.select(F.col("research_id").alias("source_id"), F.col("id").alias("document"), "title", "url"), "source_id")
    old, plan, stock = F.col("label") == OLD_YEAR, F.col("stage") == "capital_plan", F.col("said") == STOCK
    chosen = lambda values: F.when(old, values[0]).when(plan, values[1]).otherwise(values[2])
    first = F.substring("label", 1, 4).cast("int")
    end = F.concat((first + 1).cast("string"), F.lit("-03-31"))
    metric = F.replace(F.col("said"), F.lit("-"), F.lit("_"))
    words = F.replace(metric, F.lit("_"), F.lit(" "))
    period = F.struct(F.concat(first.cast("string"), F.lit("-04-01")).alias("start"), end.alias("end"), F.col("label"), F.when(stock, end).alias("as_of"))
    return rows.select(
        _numbered("finance-", "position").alias("id"), _numbered("evidence-", "position").alias("evidence_id"), F.col("document").alias("source_id"), "source_locator", "url", F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, F.lit(2), F.length(words)))).alias("title"),
        F.concat("title", F.lit(" — "), words).alias("evidence_title"), metric.alias("metric"), period.alias("period"), "stage", chosen(BASES).alias("basis"), chosen(PERIMETERS).alias("perimeter"), F.when(stock, "stock").otherwise("flow").alias("measure_type"),
        F.col("verified_value").alias("raw_value"), "unit", F.when(F.col("unit") == "CAD_millions", UNITS["CAD_millions"]).otherwise(UNITS["CAD_thousands"]).alias("multiplier"),
    )
