"""P5: reviewed bundles of three kinds as facts and the identities that are declared over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import identity

#: Declarations of native arithmetic, and fields of a portal's balance (fixed values).
SCHEDULE, TABLE, BALANCE = "same_schedule_component_sum", "same_table_documented_asset_identity", "unverified_portal_balance_mapping"
BALANCE_FIELDS = {"operatingBalance": "operating_surplus_deficit_before_financing_and_transfers", "financingAndTransfers": "total_financing_and_transfers", "reportedAnnualBalance": "annual_surplus_deficit_"}


def fact(id: Column, value: Column, locator: Column, native: Column, artifact: Column, source: Column, scope: Column, unit: str, role: Column | None = None, available: Column | None = None) -> list[Column]:
    """The columns of :data:`identity.FACTS`; currency and financial basis are never inferred."""
    none = F.lit(None).cast("string")
    return [
        id.alias("id"), value.alias("value"), (F.lit("reported") if available is None else available).alias("availability"), F.lit(unit).alias("unit"), none.alias("currency"), scope.alias("scopeKey"),
        (F.lit("component") if role is None else role).alias("role"), id.alias("sourceFactId"), F.to_json(locator).alias("sourceLocator"), artifact.alias("artifactSha256"), source.alias("sourceSnapshotSha256"),
        F.to_json(native).alias("nativeCellLocator"), none.alias("financialBasisId"), F.lit(False).alias("financialBasisVerified"),
    ]


def rule(id: Column, left: Column, right: Column, scope: Column, unit: str, kind: str, confirmed: Column) -> list[Column]:
    """The columns of :data:`identity.RULES`; ``left`` and ``right`` are arrays of (factId, coefficient)."""
    basis = F.struct(scope.alias("scopeKey"), F.lit(unit).alias("unit"), F.lit(kind).alias("nativeArithmeticDeclaration"), confirmed.alias("mappingConfirmed"), F.lit(kind == SCHEDULE).alias("componentSetComplete"), F.lit(None).cast("string").alias("financialBasisId"))
    term = lambda side, name: side.cast(f"array<{identity.TERM}>").alias(name)
    return [id.alias("id"), F.lit(1).alias("version"), F.lit("linear_identity").alias("operation"), F.lit("source_native_arithmetic").alias("mode"), term(left, "left"), term(right, "right"), basis.alias("basis")]


def _terms(*pairs: tuple[Column, int]) -> Column:
    return F.array(*[F.struct(id.alias("factId"), F.lit(sign).alias("coefficient")) for id, sign in pairs])


def schedules(records: DataFrame, totals: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """Rows of approved schedules and their printed totals: each schedule's rows, at most a hundred, come to its total.

    ``records``: schedule, position, id, amount, page, row, artifact, source. ``totals``: schedule, amount, page, artifact, source.
    """
    scope = F.col("schedule")
    cell = lambda row: F.struct(F.lit("pdf_table_cell").alias("kind"), F.col("page").alias("page"), scope.alias("table"), row.alias("row"), F.lit("grant_amount").alias("column"))
    where = F.struct(F.concat(F.lit("/records/"), F.col("position").cast("string"), F.lit("/reportedAmount")).alias("jsonPointer"), F.col("page").alias("pdfPage"))
    total_id = F.concat(scope, F.lit(":printed-schedule-total"))
    a = records.select(*fact(F.col("id"), F.col("amount"), where, cell(F.col("row").cast("string")), F.col("artifact"), F.col("source"), scope, unit))
    b = totals.select(*fact(total_id, F.col("amount"), F.struct(F.lit("/printedTotal").alias("jsonPointer"), F.col("page").alias("pdfPage")), cell(F.lit("printed_total")), F.col("artifact"), F.col("source"), scope, unit, role=F.lit("printed_total")))
    parts = records.groupBy("schedule").agg(F.sort_array(F.collect_list(F.struct("position", "id"))).alias("ids"))
    left = F.transform("ids", lambda x: F.struct(x["id"].alias("factId"), F.lit(1).alias("coefficient")))
    rules = totals.join(parts.hint("merge"), "schedule").select(*rule(F.concat(scope, F.lit("-total-v1")), left, _terms((total_id, 1)), scope, unit, SCHEDULE, F.lit(True)))
    return a.union(b), rules


def asset_tables(cells: DataFrame, specs: Mapping[str, tuple[Sequence[tuple[str, int]], str]], unit: str) -> tuple[DataFrame, DataFrame]:
    """Cells of one row of a documented table and the identities that its notes declare.

    ``cells``: entity, measure, id, value, measure_type, availability, page, table, row, column, artifact, source. ``specs``: for each
    identity the signed measures on its left and the measure on its right. An identity with a measure that an entity lacks is left out.
    """
    scope = F.col("entity")
    native = F.struct(F.lit("pdf_table_cell").alias("kind"), *[F.col(n).cast("string").alias(n) for n in ("page", "table", "row", "column")])
    facts = cells.select(*fact(F.col("id"), F.col("value"), F.struct(F.col("page").alias("pdfPage"), F.col("column").alias("sourceColumn")), native, F.col("artifact"), F.col("source"), scope, unit, role=F.col("measure_type"), available=F.col("availability")))
    measures = sorted({m for left, right in specs.values() for m in (*[n for n, _ in left], right)})
    wide = cells.groupBy("entity").agg(*[F.max(F.when(F.col("measure") == m, F.col("id"))).alias(m) for m in measures])
    parts = []
    for name, (left, right) in specs.items():
        whole = wide.dropna(subset=[*[n for n, _ in left], right])
        parts.append(whole.select(*rule(F.concat(scope, F.lit(f"-{name}-v1")), _terms(*[(F.col(n), sign) for n, sign in left]), _terms((F.col(right), 1)), scope, unit, TABLE, F.lit(True))))
    rules = parts[0]
    for p in parts[1:]:
        rules = rules.union(p)
    return facts, rules


def balances(evidence: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """Portal rows: operating balance plus financing is the annual balance, by a mapping that is confirmed only where ``verified`` says so.

    ``evidence``: row_id, fiscal_year, type, verified, artifact, source, and a column for each field of ``BALANCE_FIELDS``.
    """
    scope = F.concat_ws("|", "row_id", "fiscal_year", "type")
    id = lambda field: F.concat_ws(":", F.col("row_id"), F.lit(field))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(source).alias("column"), F.col(f).alias("value")) for f, source in BALANCE_FIELDS.items()])
    each = evidence.withColumn("f", F.explode(fields))
    native = F.struct(F.lit("dataset_cell").alias("kind"), F.col("row_id").alias("rowId"), F.col("f.column").alias("field"))
    facts = each.select(*fact(F.concat_ws(":", "row_id", "f.field"), F.col("f.value"), F.struct(F.col("row_id").alias("sourceRowId"), F.col("f.column").alias("sourceField")), native, F.col("artifact"), F.col("source"), scope, unit))
    operating, financing, annual = BALANCE_FIELDS
    rules = evidence.select(*rule(F.concat(F.lit("municipal-"), F.col("row_id"), F.lit("-balance-v1")), _terms((id(operating), 1), (id(financing), 1)), _terms((id(annual), 1)), scope, unit, BALANCE, F.col("verified")))
    return facts, rules
