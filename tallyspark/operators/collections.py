"""Constraint suites of the reviewed collections (§2.13), each a list of rules for :func:`gates.violations`.

Row shapes are flat: ``id`` and snake-case columns; amounts are text. Population sizes are parameters,
since they belong to a bundle's own coverage statement. Rules that compare with another collection
take its DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import fiscal_bounds, fiscal_year, is_date, period_holds, strict_date
from ..functions.exact import MULTIPLIER, cents, holds, is_decimal, multiplier_of, rounded_percent_holds, scale_exact, source_token, sum_known, to_decimal
from ..functions.urls import safe_url
from .filters import STATUSES
from .gates import Rule, agg, covers, fk, group, key, named, row, within
from .identity import STAGE_PAIRS

STAGES = ("original_estimate", "amended_estimate", "adjusted_estimate", "audited_actual", "capital_plan")
c = F.col


def size(n: int | None) -> list[Rule]:
    return [] if n is None else [agg("population", F.count("*") == n)]


def token_rules(dash: str = "-", token: str = "raw_token", value: str = "raw_value") -> list[Rule]:
    """A printed cell, its presence and its exact value say the same; missing is never zero."""
    read = source_token(c(token), dash)
    return [row("presence", c("presence") == read["presence"]), row("token_value", c(value).eqNullSafe(read["value"])), row("no_malformed", read["presence"] != "malformed")]


def unknown_currency() -> list[Rule]:
    return [row("currency_unknown", c("currency").isNull()), row("multiplier_unknown", c("multiplier").isNull())]


def flags_off(*names: str) -> list[Rule]:
    return [row(f"not_{n}", ~c(n)) for n in names]


def foundation(evidence: DataFrame, sources: DataFrame) -> list[Rule]:
    """Facts with full dimensions: id, title, stage, measure_type, currency, unit, multiplier, period columns, raw_value, evidence_id, source_id."""
    exact = c("raw_value").isNull() | (is_decimal(c("raw_value")) & scale_exact(c("raw_value"), c("multiplier")).isNotNull())
    return [
        *named(), row("stage", c("stage").isin(*STAGES)), row("currency", c("currency") == "CAD"), row("unit", c("unit").isin(*MULTIPLIER) & (c("multiplier") == multiplier_of(c("unit")))),
        row("period", period_holds(c("measure_type"), c("period_start"), c("period_end"), c("period_as_of"))), row("label", F.length(c("period_label")) > 0), row("value", exact),
        row("basis", (F.length(c("accounting_basis")) > 0) & (F.length(c("reporting_perimeter")) > 0) & (F.length(c("source_locator")) > 0)),
        fk("evidence", ["evidence_id"], evidence, ["id"]), fk("source", ["source_id"], sources, ["id"]), fk("same_source", ["evidence_id", "source_id"], evidence, ["id", "source_id"]),
    ]


def source_references(n_urls: int | None = None, n: int | None = None) -> list[Rule]:
    """References with https URLs; every one is a guide entry or a supporting document."""
    rules = [*named(), row("url", safe_url(c("url")).isNotNull()), row("group", c("group").isin("guide", "supporting")), *size(n)]
    return rules + ([agg("urls", F.count_distinct("url") == n_urls)] if n_urls else [])


def tenders(n: int | None = None) -> list[Rule]:
    """Awards: id, source_row_id, tender_id, publisher, awarded, closed, started (text dates), amount (text), categories (map)."""
    dates = [row(f"date_{d}", c(d).isNull() | is_date(c(d))) for d in ("awarded", "closed", "started")]
    closed = F.array_sort(F.map_keys("categories")) == F.array(*map(F.lit, ("construction", "goods", "service")))
    flags = F.forall(F.map_values("categories"), lambda v: F.coalesce(v.isin("Y", "N"), F.lit(False)))
    return [*named(), *[row(f"known_{x}", c(x).isNotNull()) for x in ("source_row_id", "tender_id", "publisher")], *dates, row("categories", closed & flags), row("amount", c("amount").isNull() | is_decimal(c("amount"))), *size(n)]


def suppliers(observations: DataFrame, n_labels: int | None = None) -> list[Rule]:
    """Labels: observation_id, source_row_id, supplier_label, and flags that no identity is claimed."""
    rules = [row("label", F.length(F.trim(c("supplier_label"))) > 0), key("observation_unique", "observation_id"), fk("observation", ["observation_id", "source_row_id"], observations, ["id", "source_row_id"])]
    rules += flags_off("identity_resolved", "legal_entity_verified", "payment_evidence", "aggregation_allowed")
    return rules + ([agg("labels", F.count_distinct("supplier_label") == n_labels)] if n_labels else [])


def municipal(measures: Sequence[str], n: int | None = None) -> list[Rule]:
    """Rows with a closed map of measures, each present with exact text or missing without."""
    names = F.array_sort(F.map_keys("measures")) == F.array(*map(F.lit, sorted(measures)))
    each = F.forall(F.map_values("measures"), lambda m: F.coalesce(F.when(m["presence"] == "present", is_decimal(m["rawValue"])).when(m["presence"] == "missing", m["rawValue"].isNull()), F.lit(False)))
    return [*named(), key("year_unique", "municipality", "municipality_type", "fiscal_year"), row("measures", names), row("values", each), *unknown_currency(), *size(n)]


def municipal_capital(n_values: int = 9) -> list[Rule]:
    """Rows of capital figures: row_role, is_placeholder, values (array of struct measureType, availability, value, asOf)."""
    each = F.forall("values", lambda v: F.coalesce((v["availability"] == "reported") == v["value"].isNotNull(), F.lit(False)) & F.coalesce((v["measureType"] == "stock") == v["asOf"].isNotNull(), F.lit(False)))
    return [*named(), row("role", c("row_role").isin("municipality", "published_aggregate")), row("no_placeholder", ~c("is_placeholder")), row("columns", F.size("values") == n_values), row("values", each)]


def budget(columns: DataFrame, n: int | None = None) -> list[Rule]:
    """Cells: table, column_index, fiscal_year, stage, raw_token, raw_value, presence; a column fixes year and stage, ``---`` is a dash."""
    return [*named(), *token_rules("---"), fk("column", ["table", "column_index", "fiscal_year", "stage"], columns), row("unit", c("multiplier") == multiplier_of(c("unit"))), *flags_off("payment_evidence"), *size(n)]


def budget_pages(pages: DataFrame, source_pdf_sha: str, slots: int | None = None, present: int | None = None, lines: int | None = None) -> list[Rule]:
    """Where cells stand, beside :func:`budget`: table, section, label, presence, pdf_page, source_pdf_sha, latest_forecast_claim.

    ``pages``: table, first_page, last_page, both ends included. A cell is on a page of its table and of the bundle's document, and claims no latest
    forecast. The coverage counts cells (``slots``), those with a value (``present``) and different lines of tables.
    """
    counted = {"slots": (F.count("*"), slots), "present": (F.count_if(c("presence") == "present"), present), "lines": (F.count_distinct(F.struct("table", "section", "label")), lines)}
    return [within("page", ["table"], "pdf_page", pages, "first_page", "last_page"), row("same_pdf", c("source_pdf_sha") == source_pdf_sha), *flags_off("latest_forecast_claim"), *[agg(name, found == n) for name, (found, n) in counted.items() if n is not None]]


def transfers(n: int | None = None) -> list[Rule]:
    """Payments: jurisdiction, program_code, payment_date, fiscal_year, table_index, raw_token, raw_value, presence."""
    same_year = fiscal_year(strict_date(c("payment_date"))) == c("fiscal_year")
    blank_or_present = c("presence").isin("blank", "present")
    return [*named(), key("payment_unique", "jurisdiction", "program_code", "payment_date"), row("date", is_date(c("payment_date"))), row("fiscal_year", same_year), row("presence_kind", blank_or_present), *token_rules(), row("multiplier", c("multiplier") == 1), *flags_off("future_payment"), *size(n)]


def transfer_summaries() -> list[Rule]:
    """A program's year: values present in every cell, their sum, count and completeness as printed.

    Over payments joined to their summary: program_code, fiscal_year, payment_date, raw_value, reported_sum, date_count, full_year.
    """
    value = to_decimal(c("raw_value"), 0)
    return [group("sum", sum_known(value) == F.first(to_decimal(c("reported_sum"), 0)), "program_code", "fiscal_year"), group("count", F.count("*") == F.first("date_count"), "program_code", "fiscal_year")]


def institution(roles: DataFrame) -> list[Rule]:
    """Statement cells: label, aggregation_role, measure_type, fiscal_year, period columns, token; a label fixes its role, ``-`` is a dash."""
    bounds = fiscal_bounds(c("fiscal_year"))
    starts = (c("measure_type") == "stock") | (c("period_start") == F.date_format(bounds["start"], "yyyy-MM-dd"))
    ends = c("period_end") == F.date_format(bounds["end"], "yyyy-MM-dd")
    return [*named(), *token_rules("-"), fk("role", ["label", "aggregation_role"], roles), row("start", starts), row("end", ends), row("period", period_holds(c("measure_type"), c("period_start"), c("period_end"), c("period_as_of")))]


def balanced(by: Sequence[str], coefficient: str = "coefficient", value: str = "value") -> list[Rule]:
    """A10, A11, A20, A22 (cash bridge, capital explanation, water, approvals): signed terms of each equation come to zero, none missing."""
    return [row("term_known", c(value).isNotNull()), row("sign", c(coefficient).isin(-1, 1)), group("residual_zero", sum_known(c(coefficient) * c(value)) == 0, *by)]


def authorizations(orders: DataFrame) -> list[Rule]:
    """Clauses: id, order_number, clause, raw_value; ids are composed, sums by order are the printed ones (joined as reported_total)."""
    composed = c("id") == F.concat_ws("-", "order_number", "clause")
    return [*named(), row("id_composed", composed), fk("order", ["order_number"], orders), group("order_total", sum_known(to_decimal(c("raw_value"), 0)) == F.first(to_decimal(c("reported_total"), 0)), "order_number")]


def purpose(clauses: DataFrame) -> list[Rule]:
    """A purpose names one clause of one order exactly."""
    return [key("one_per_clause", "order_number", "record_id", "clause"), fk("clause", ["order_number", "record_id", "clause"], clauses, ["order_number", "id", "clause"])]


def governance(footnotes: DataFrame) -> list[Rule]:
    """An order and the budget footnote that it answers, by number, program, portfolio and digest."""
    return [fk("footnote", ["order_number", "program", "portfolio", "pdf_sha"], footnotes)]


def reporting() -> list[Rule]:
    """Two sources on one year: a + b = c and c - d = residual; the rounded profile is never subtracted."""
    d = lambda x: to_decimal(c(x), 2)
    return [*named(), row("calculated", d("operating") + d("financing") == d("calculated")), row("residual", d("calculated") - d("reported") == d("residual")), row("profile_untouched", c("profile_difference").isNull())]


def audits(n: int | None = None) -> list[Rule]:
    """Recommendation counts that add up and rounded percentages that fit them."""
    return [*named(), row("sum", c("completed") + c("not_completed") == c("total")), row("percent", rounded_percent_holds(c("percent"), c("completed"), c("total"))), *flags_off("current_status_verified"), *size(n)]


def audit_cohorts(main_years: Sequence[int], additional_year: int) -> list[Rule]:
    """Counts of the main years by cohort, over records joined to their cohort's printed totals.

    Columns: audit_year, completed, not_completed, total, cohort_completed, cohort_total (null for the additional year, which is
    never part of a cohort), main_completed, main_not_completed, main_total (the printed sums of the main years, in every row).
    """
    main = c("audit_year").isin(*main_years)
    part = lambda x: F.sum(F.when(main, c(x)))
    both = (F.sum("total") == F.first("cohort_total")) & (F.sum("completed") == F.first("cohort_completed"))
    rules = [row("year", main | (c("audit_year") == additional_year)), row("cohort", main == c("cohort_total").isNotNull()), group("cohort_sum", ~F.first(main) | both, "audit_year")]
    return rules + [agg(f"main_{x}", part(x) == F.first(f"main_{x}")) for x in ("completed", "not_completed", "total")]


def audit_recommendations(pages: Mapping[str, Sequence[tuple[int, int]]] | None = None, completed: Mapping[str, Sequence[int]] | None = None, prefix: str = "") -> list[Rule]:
    """Recommendations numbered without gaps in each audit, each on the printed page and with the status that its number says.

    ``pages``: for each audit (last number, page) in order; ``completed``: for each audit the numbers that are completed. With a
    ``prefix`` ids are composed of it, the audit and the number in two digits. The PDF's page is the one after the printed one.
    """
    rules = [*named(), key("number_unique", "audit_id", "number"), group("numbers_gapless", (F.max("number") == F.count("*")) & (F.min("number") == 1), "audit_id"), row("status", c("status").isin(*STATUSES))]
    if pages:
        on = F.coalesce(*[F.when((c("audit_id") == a) & (c("number") <= last), F.lit(page)) for a, parts in pages.items() for last, page in parts])
        rules += [row("page", c("printed_page") == on), row("pdf_page", c("pdf_page") == c("printed_page") + 1)]
    if completed:
        done = F.coalesce(*[F.when(c("audit_id") == a, c("number").isin(*numbers)) for a, numbers in completed.items()])
        rules.append(row("status_set", c("status") == F.when(done, STATUSES[0]).otherwise(STATUSES[1])))
        rules.append(row("known_audit", c("audit_id").isin(*completed)))
    if prefix:
        rules.append(row("id_composed", c("id") == F.concat(F.lit(prefix), c("audit_id"), F.lit("-"), F.lpad(c("number").cast("string"), 2, "0"))))
    return rules + flags_off("current_status_verified")


def column_totals(columns: Sequence[str], total: str = "is_total") -> list[Rule]:
    """In each column the parts come to the printed total."""
    part = lambda x: F.sum(F.when(~c(total), c(x)))
    whole = lambda x: F.sum(F.when(c(total), c(x)))
    return [agg(f"total_{x}", (part(x) == whole(x)) & (F.count_if(c(x).isNull()) == 0)) for x in columns]


def facilities() -> list[Rule]:
    """Facility counts of a group come to the group's count; groups are never combined."""
    return [*named(), group("group_count", F.sum("facility_count") == F.first("group_count"), "group_id")]


def winter(expected: DataFrame) -> list[Rule]:
    """The literal cells are the expected ones, none more and none missing; no rate over both kinds of report may be given."""
    return [*named(), fk("cells", ["id", "group_id", "cell"], expected), covers("cells_complete", ["id", "group_id", "cell"], expected), row("no_combined_rate", c("combined_rate").isNull())]


def anonymous_case(aliases: Sequence[str]) -> list[Rule]:
    """Housing and ambulance: only the agreed aliases appear; a cell is not applicable, a rate or an amount."""
    kind = F.when(c("cell") == "N/A", "not_applicable").when(c("cell").rlike(r"\A[0-9]+(\.[0-9]+)?%\z"), "rate").when(c("cell").rlike(r"\A\$[0-9,]+(\.[0-9]+)?\z"), "amount")
    return [*named(), row("alias", c("alias").isin(*aliases)), row("cell_kind", c("kind") == kind)]


def grants(printed: Column) -> list[Rule]:
    """A4: exact cents without currency; the residual to the printed total is disclosed, not hidden. ``printed`` is the total in cents' decimal."""
    value = cents(c("reported_amount"))
    return [*named(), row("amount", value.isNotNull()), row("currency_unknown", c("currency").isNull()), *flags_off("settlement_verified"), row("no_motion", c("official_motion_id").isNull()), agg("residual_disclosed", sum_known(value) - printed == F.first("disclosed_residual"))]


def physician(n: int | None = None) -> list[Rule]:
    """Amounts whose sign is what their status says; a category-year occurs once."""
    value = to_decimal(c("reported_amount"), 2)
    status = F.when(value < 0, "negative_reported_value").when(value == 0, "explicit_zero").when(value > 0, "positive_reported_value")
    return [*named(), key("category_unique", "year", "type", "subcategory"), row("status", c("amount_status") == status), row("year", fiscal_bounds(c("year")).isNotNull()), *size(n)]


def statements() -> list[Rule]:
    """All components of a column come to its total, none missing."""
    value = to_decimal(c("value"), 2)
    part, total = F.when(c("role") == "component", value), F.when(c("role") == "total", value)
    complete = F.count_if((c("role") == "component") & value.isNull()) == 0
    return [*named(), row("role", c("role").isin("component", "total")), group("column_total", complete & (F.sum(part) == F.sum(total)), "table", "source_column")]


def differences() -> list[Rule]:
    """Actual less budget of each line is the printed difference; a line with a missing amount has none."""
    actual, planned, printed = (to_decimal(c(x), 2) for x in ("actual", "budget", "difference"))
    return [*named(), row("difference", F.coalesce(actual - planned == printed, actual.isNull() | planned.isNull())), row("missing_has_none", actual.isNotNull() & planned.isNotNull() | c("difference").isNull())]


def funding_bridge() -> list[Rule]:
    """A comparison is performed only if its result cell and all components are numbers."""
    all_known = F.forall("components", lambda v: v.isNotNull())
    allowed = all_known & c("result").isNotNull()
    return [*named(), row("performed", c("performed") == allowed), row("status", c("status") == F.when(allowed, "compared").when(~all_known, "insufficient_evidence").otherwise("not_performed"))]


def register(n_by_section: Mapping[str, int] | None = None, month: str = "2026-01") -> list[Rule]:
    """A3: cheques of one month: four identities, exact cents, dates in the month, counts by section."""
    rules = [*named(), key("cheque_unique", "chequebook_id", "cheque_number"), row("amount", cents(c("reported_amount")).isNotNull()), row("month", is_date(c("cheque_date")) & c("cheque_date").startswith(month + "-"))]
    if n_by_section:
        want = F.coalesce(*[F.when(F.first("section") == s, F.lit(n)) for s, n in n_by_section.items()])
        rules.append(group("section_count", F.count("*") == want, "section"))
    return rules


def water() -> list[Rule]:
    """Spent less budget is the amount printed as under budget; the other column is blank, which is unknown and not zero."""
    return [*named(), row("under", c("spent") - c("budget") == c("under")), row("over_unknown", c("over").isNull()), row("matters", F.size("matter_ids") > 0)]


def water_services() -> list[Rule]:
    """By service, spent and budget come to the calculated and the narrated sums, and their difference to the net one.

    Over projects joined to their service's reconciliation: service_group, id, spent, budget, project_ids, calculated_spent, narrated_spent,
    calculated_budget, calculated_net, narrated_net, and the flag that the net is additional money, which it is not.
    """
    spent, budget = sum_known(c("spent")), sum_known(c("budget"))
    same = lambda value, *names: reduce(lambda a, b: a & b, [value == F.first(n) for n in names])
    return [
        row("service", c("service_group").isin("water", "wastewater")), group("projects", F.sort_array(F.collect_set("id")) == F.array_sort(F.first("project_ids")), "service_group"),
        group("spent", same(spent, "calculated_spent", "narrated_spent"), "service_group"), group("budget", same(budget, "calculated_budget"), "service_group"),
        group("net", same(budget - spent, "calculated_net", "narrated_net"), "service_group"), *flags_off("is_additional_money"),
    ]


def superseding(earlier: DataFrame) -> list[Rule]:
    """Versions: a bundle (id, sha, supersedes_sha) that replaces another names it by digest, is not its own predecessor, and both are kept; ``earlier``: sha."""
    return [*named(), key("one_successor", "supersedes_sha"), fk("predecessor", ["supersedes_sha"], earlier, ["sha"]), row("not_itself", c("sha") != c("supersedes_sha"))]


def transit_total() -> list[Rule]:
    """Parts against the overall row: the residual is disclosed, not hidden. Columns: is_overall, actual, planned, and in every row component_actual, component_planned, disclosed_residual."""
    part = lambda x: F.sum(F.when(~c("is_overall"), c(x)))
    whole = lambda x: F.sum(F.when(c("is_overall"), c(x)))
    return [
        agg("one_overall", F.count_if(c("is_overall")) == 1), agg("actual_parts", part("actual") == F.first("component_actual")), agg("planned_parts", part("planned") == F.first("component_planned")),
        agg("residual", part("actual") - whole("actual") == F.first("disclosed_residual")), row("known", c("actual").isNotNull() & c("planned").isNotNull()),
    ]


def transit() -> list[Rule]:
    """Actual less planned; whole objects equal the reviewed ones by canonical form (``canonical``, ``reviewed``)."""
    return [*named(), row("difference", c("actual").isNull() | (c("actual") - c("planned") == c("difference"))), row("object", c("canonical") == c("reviewed"))]


def methodology() -> list[Rule]:
    """The numbers of recurring groups and of distinct references are those counted (columns counted_*)."""
    return [row("recurring", c("recurring_groups") == c("counted_recurring")), row("distinct", c("distinct_references") == c("counted_distinct"))]


def coverage(source_ids: DataFrame) -> list[Rule]:
    """Directory rows: a positive count, a digest, a route, no claim of completeness, known related sources."""
    return [*named(), row("count", c("count") >= 1), row("digest", c("data_sha").rlike(r"\A[a-f0-9]{64}\z")), row("route", c("route").startswith("#/")), *flags_off("complete_source_coverage", "scheduled_refresh"), fk("source", ["related_source_id"], source_ids, ["id"])]


def comparisons() -> list[Rule]:
    """Case calculations: a known stage pair whose difference reproduces, raw and scaled."""
    difference = to_decimal(c("after"), 6) - to_decimal(c("before"), 6)
    return [*named(), row("stages", F.concat_ws(":", "before_stage", "after_stage").isin(*STAGE_PAIRS)), row("raw", difference == to_decimal(c("difference"), 6)), row("scaled", holds(scale_exact(c("difference"), c("multiplier")) == c("scaled_difference")))]
