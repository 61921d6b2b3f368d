"""Each suite admits its good rows and refuses every mutation of them."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import collections as suites
from tallyspark.operators.gates import violations


def frame(spark, ddl, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], ddl)


def foundation(spark):
    ev = spark.createDataFrame([("e", "s")], "id string, source_id string")
    ddl = "id string, stage string, measure_type string, currency string, unit string, multiplier long, period_start string, period_end string, period_as_of string, period_label string, raw_value string, accounting_basis string, reporting_perimeter string, source_locator string, evidence_id string, source_id string"
    row = dict(id="f", stage="audited_actual", measure_type="flow", currency="CAD", unit="CAD_thousands", multiplier=1000, period_start="2024-04-01", period_end="2025-03-31", period_as_of=None, period_label="2024-25", raw_value="1.5", accounting_basis="a", reporting_perimeter="p", source_locator="l", evidence_id="e", source_id="s")
    return ddl, [row], suites.foundation(ev, ev.select(F.col("source_id").alias("id"))), [dict(currency="USD"), dict(multiplier=1), dict(stage="x"), dict(period_as_of="2025-03-31"), dict(raw_value="1.00001"), dict(evidence_id="z"), dict(source_id=None), dict(period_end="2024-02-30")]


def tenders(spark):
    ddl = "id string, source_row_id string, tender_id string, publisher string, awarded string, closed string, started string, amount string, categories map<string,string>"
    flags = {"construction": "N", "goods": "Y", "service": "N"}
    row = dict(id="a", source_row_id="1", tender_id="t", publisher="p", awarded="2024-01-01", closed=None, started=None, amount="1.0", categories=flags)
    return ddl, [row], suites.tenders(1), [dict(awarded="2024-1-1"), dict(amount="1,0"), dict(categories=flags | {"goods": "y"}), dict(categories={"goods": "Y"}), dict(publisher=None)]


def suppliers(spark):
    obs = spark.createDataFrame([("a", "1")], "id string, source_row_id string")
    ddl = "id string, observation_id string, source_row_id string, supplier_label string, identity_resolved boolean, legal_entity_verified boolean, payment_evidence boolean, aggregation_allowed boolean"
    row = dict(id="x", observation_id="a", source_row_id="1", supplier_label="L", identity_resolved=False, legal_entity_verified=False, payment_evidence=False, aggregation_allowed=False)
    return ddl, [row], suites.suppliers(obs, 1), [dict(source_row_id="2"), dict(supplier_label=" "), dict(identity_resolved=True), dict(payment_evidence=None)]


def municipal(spark):
    ddl = "id string, municipality string, municipality_type string, fiscal_year string, measures map<string,struct<presence:string,rawValue:string>>, currency string, multiplier long"
    m = {"a": ("present", "0"), "b": ("missing", None)}
    row = dict(id="i", municipality="m", municipality_type="t", fiscal_year="2024-25", measures=m, currency=None, multiplier=None)
    return ddl, [row], suites.municipal(["a", "b"], 1), [dict(measures={"a": ("present", "0")}), dict(measures=m | {"a": ("present", None)}), dict(measures=m | {"b": ("missing", "0")}), dict(currency="CAD")]


def capital(spark):
    ddl = "id string, row_role string, is_placeholder boolean, values array<struct<measureType:string,availability:string,value:string,asOf:string>>"
    v = [("flow", "reported", "1", None), ("stock", "missing", None, "2024-03-31")]
    return ddl, [dict(id="c", row_role="published_aggregate", is_placeholder=False, values=v)], suites.municipal_capital(2), [dict(values=v[:1]), dict(values=[v[0], ("stock", "missing", "0", "2024-03-31")]), dict(values=[v[0], ("stock", "missing", None, None)]), dict(row_role="x"), dict(is_placeholder=True)]


def budget(spark):
    cols = spark.createDataFrame([("t", 1, "2024-25", "original_estimate")], "table string, column_index int, fiscal_year string, stage string")
    ddl = "id string, table string, column_index int, fiscal_year string, stage string, raw_token string, raw_value string, presence string, unit string, multiplier long, payment_evidence boolean"
    row = dict(id="b", table="t", column_index=1, fiscal_year="2024-25", stage="original_estimate", raw_token="(1,234)", raw_value="-1234", presence="present", unit="CAD_thousands", multiplier=1000, payment_evidence=False)
    return ddl, [row], suites.budget(cols, 1), [dict(raw_value="1234"), dict(raw_token="---"), dict(column_index=2), dict(multiplier=1), dict(payment_evidence=True)]


def transfers(spark):
    ddl = "id string, jurisdiction string, program_code string, payment_date string, fiscal_year string, raw_token string, raw_value string, presence string, multiplier int, future_payment boolean"
    row = dict(id="p", jurisdiction="J", program_code="P", payment_date="2024-04-01", fiscal_year="2024-25", raw_token="1,000", raw_value="1000", presence="present", multiplier=1, future_payment=False)
    return ddl, [row, row | dict(id="q", payment_date="2024-04-15", raw_token="", raw_value=None, presence="blank")], suites.transfers(2), [dict(fiscal_year="2023-24"), dict(raw_value="1001"), dict(payment_date="2024-04-15"), dict(presence="blank"), dict(multiplier=1000)]


def institution(spark):
    roles = spark.createDataFrame([("l", "total")], "label string, aggregation_role string")
    ddl = "id string, label string, aggregation_role string, measure_type string, fiscal_year string, period_start string, period_end string, period_as_of string, raw_token string, raw_value string, presence string"
    row = dict(id="n", label="l", aggregation_role="total", measure_type="flow", fiscal_year="2024-25", period_start="2024-04-01", period_end="2025-03-31", period_as_of=None, raw_token="-", raw_value=None, presence="source_dash")
    return ddl, [row], suites.institution(roles), [dict(raw_value="0"), dict(aggregation_role="component"), dict(period_end="2025-03-30"), dict(measure_type="stock")]


def balanced(spark):
    ddl = "id string, eq string, coefficient int, value int"
    rows = [dict(id="1", eq="e", coefficient=1, value=3), dict(id="2", eq="e", coefficient=-1, value=3)]
    return ddl, rows, suites.balanced(["eq"]), [dict(value=4), dict(coefficient=2), dict(value=None)]


def authorizations(spark):
    orders = spark.createDataFrame([("O1",)], "order_number string")
    ddl = "id string, order_number string, clause string, raw_value string, reported_total string"
    rows = [dict(id="O1-a", order_number="O1", clause="a", raw_value="1", reported_total="3"), dict(id="O1-b", order_number="O1", clause="b", raw_value="2", reported_total="3")]
    return ddl, rows, suites.authorizations(orders), [dict(raw_value="2"), dict(id="x"), dict(order_number="O2"), dict(raw_value=None)]


def reporting(spark):
    ddl = "id string, operating string, financing string, calculated string, reported string, residual string, profile_difference string"
    row = dict(id="r", operating="1.10", financing="2.20", calculated="3.30", reported="3.00", residual="0.30", profile_difference=None)
    return ddl, [row], suites.reporting(), [dict(residual="0.31"), dict(operating="1.11"), dict(reported=None), dict(profile_difference="1")]


def audits(spark):
    ddl = "id string, completed int, not_completed int, total int, percent int, current_status_verified boolean"
    return ddl, [dict(id="a", completed=2, not_completed=1, total=3, percent=67, current_status_verified=False)], suites.audits(1), [dict(total=4), dict(percent=66), dict(completed=None), dict(current_status_verified=True)]


def recommendations(spark):
    ddl = "id string, audit_id string, number int, status string, printed_page int, pdf_page int, current_status_verified boolean"
    rows = [dict(id=f"x-A-0{n}", audit_id="A", number=n, status=s, printed_page=p, pdf_page=p + 1, current_status_verified=False) for n, s, p in ((1, "Completed", 4), (2, "Incomplete", 4), (3, "Incomplete", 5))]
    rules = suites.audit_recommendations({"A": [(2, 4), (9, 5)]}, {"A": [1]}, "x-")
    return ddl, rows, rules, [dict(number=4), dict(number=2), dict(status="Done"), dict(status="Incomplete"), dict(printed_page=3), dict(printed_page=5, pdf_page=6), dict(pdf_page=9), dict(id="x-A-09"), dict(audit_id="B")]


def totals(spark):
    ddl = "id string, x int, is_total boolean"
    return ddl, [dict(id="a", x=3, is_total=True), dict(id="b", x=1, is_total=False), dict(id="c", x=2, is_total=False)], suites.column_totals(["x"]), [dict(x=4), dict(is_total=False), dict(x=None)]


def facilities(spark):
    ddl = "id string, group_id string, facility_count int, group_count int"
    return ddl, [dict(id="a", group_id="g", facility_count=1, group_count=3), dict(id="b", group_id="g", facility_count=2, group_count=3)], suites.facilities(), [dict(facility_count=2), dict(facility_count=None), dict(group_id="h")]


def case(spark):
    ddl = "id string, alias string, cell string, kind string"
    return ddl, [dict(id="a", alias="Home A", cell="12.5%", kind="rate")], suites.anonymous_case(["Home A"]), [dict(alias="Real Name"), dict(kind="amount"), dict(cell="12.5"), dict(cell="N/A")]


def grants(spark):
    ddl = "id string, reported_amount string, currency string, settlement_verified boolean, official_motion_id string, disclosed_residual decimal(38,2)"
    from decimal import Decimal

    rows = [dict(id=i, reported_amount=a, currency=None, settlement_verified=False, official_motion_id=None, disclosed_residual=Decimal("-0.50")) for i, a in (("a", "1.00"), ("b", "2.00"))]
    return ddl, rows, suites.grants(F.lit("3.50").cast("decimal(38,2)")), [dict(reported_amount="1.01"), dict(reported_amount="1"), dict(currency="CAD"), dict(official_motion_id="m")]


def physician(spark):
    ddl = "id string, year string, type string, subcategory string, reported_amount string, amount_status string"
    row = dict(id="a", year="2023-2024", type="t", subcategory="s", reported_amount="0.00", amount_status="explicit_zero")
    return ddl, [row], suites.physician(1), [dict(reported_amount="-1.00"), dict(reported_amount=None), dict(year="2023-2025"), dict(amount_status="positive_reported_value")]


def statements(spark):
    ddl = "id string, table string, source_column string, role string, value string"
    rows = [dict(id=i, table="t", source_column="2025", role=r, value=v) for i, r, v in (("a", "component", "1"), ("b", "component", "2"), ("t", "total", "3"))]
    return ddl, rows, suites.statements(), [dict(value="2"), dict(value=None), dict(role="total"), dict(role="other")]


def bridge(spark):
    ddl = "id string, components array<int>, result int, performed boolean, status string"
    rows = [dict(id="a", components=[1, -1], result=0, performed=True, status="compared"), dict(id="b", components=[1, None], result=None, performed=False, status="insufficient_evidence"), dict(id="c", components=[1], result=None, performed=False, status="not_performed")]
    return ddl, rows, suites.funding_bridge(), [dict(components=[1, None]), dict(result=None), dict(performed=False), dict(status="not_performed")]


def register(spark):
    ddl = "id string, section string, chequebook_id string, cheque_number string, cheque_date string, reported_amount string"
    row = dict(id="a", section="s", chequebook_id="c", cheque_number="1", cheque_date="2026-01-31", reported_amount="10.00")
    return ddl, [row], suites.register({"s": 1}), [dict(cheque_date="2026-02-01"), dict(reported_amount="10"), dict(section="t"), dict(cheque_date="2026-01-32")]


def water(spark):
    ddl = "id string, spent long, budget long, under long, over long, matter_ids array<string>"
    return ddl, [dict(id="w", spent=3, budget=5, under=-2, over=None, matter_ids=["m"])], suites.water(), [dict(under=1), dict(over=1), dict(spent=None), dict(matter_ids=[])]


def transit(spark):
    ddl = "id string, actual int, planned int, difference int, canonical string, reviewed string"
    return ddl, [dict(id="t", actual=3, planned=5, difference=-2, canonical="{}", reviewed="{}")], suites.transit(), [dict(difference=2), dict(canonical="[]"), dict(planned=None)]


def coverage(spark):
    ids = spark.createDataFrame([("s",)], "id string")
    ddl = "id string, count int, data_sha string, route string, complete_source_coverage boolean, scheduled_refresh boolean, related_source_id string"
    return ddl, [dict(id="c", count=1, data_sha="a" * 64, route="#/x", complete_source_coverage=False, scheduled_refresh=False, related_source_id="s")], suites.coverage(ids), [dict(count=0), dict(data_sha="A" * 64), dict(route="/x"), dict(complete_source_coverage=True), dict(related_source_id="t")]


def comparisons(spark):
    ddl = "id string, before_stage string, after_stage string, before string, after string, difference string, multiplier long, scaled_difference long"
    row = dict(id="c", before_stage="original_estimate", after_stage="amended_estimate", before="17770390", after="17823982", difference="53592", multiplier=1000, scaled_difference=53592000)
    return ddl, [row], suites.comparisons(), [dict(after_stage="audited_actual"), dict(after="17823983"), dict(scaled_difference=53592), dict(before=None)]


def references(spark):
    ddl = "id string, url string, group string"
    return ddl, [dict(id="r", url="https://a.b", group="guide")], suites.source_references(1, 1), [dict(url="http://a.b"), dict(group="x"), dict(url=None)]


def purposes(spark):
    clauses = spark.createDataFrame([("O", "r", "a")], "order_number string, id string, clause string")
    ddl = "id string, order_number string, record_id string, clause string"
    return ddl, [dict(id="p", order_number="O", record_id="r", clause="a")], suites.purpose(clauses), [dict(clause="b"), dict(record_id=None), dict(order_number="P")]


def governance(spark):
    notes = spark.createDataFrame([("O", "p", "f", "s")], "order_number string, program string, portfolio string, pdf_sha string")
    ddl = "id string, order_number string, program string, portfolio string, pdf_sha string"
    return ddl, [dict(id="g", order_number="O", program="p", portfolio="f", pdf_sha="s")], suites.governance(notes), [dict(program="q"), dict(pdf_sha=None), dict(portfolio="z")]


def winter(spark):
    expected = spark.createDataFrame([("w", "g", "12")], "id string, group_id string, cell string")
    ddl = "id string, group_id string, cell string, combined_rate double"
    return ddl, [dict(id="w", group_id="g", cell="12", combined_rate=None)], suites.winter(expected), [dict(cell="13"), dict(cell=None), dict(combined_rate=0.5)]


def methodology(spark):
    ddl = "id string, recurring_groups int, counted_recurring int, distinct_references int, counted_distinct int"
    return ddl, [dict(id="m", recurring_groups=5, counted_recurring=5, distinct_references=9, counted_distinct=9)], suites.methodology(), [dict(counted_recurring=4), dict(distinct_references=None), dict(counted_distinct=10)]


def summaries(spark):
    ddl = "id string, program_code string, fiscal_year string, raw_value string, reported_sum string, date_count long"
    rows = [dict(id=i, program_code="P", fiscal_year="2024-25", raw_value=v, reported_sum="3", date_count=2) for i, v in (("a", "1"), ("b", "2"))]
    return ddl, rows, suites.transfer_summaries(), [dict(raw_value="2"), dict(raw_value=None), dict(fiscal_year="2023-24")]


SUITES = [
    foundation, tenders, suppliers, municipal, capital, budget, transfers, summaries, institution, balanced, authorizations, purposes, governance, reporting, audits, recommendations, totals, facilities, winter,
    case, grants, physician, statements, bridge, register, water, transit, methodology, references, coverage, comparisons,
]


@pytest.mark.parametrize("suite", SUITES, ids=lambda f: f.__name__)
def test_suite(spark, suite):
    ddl, rows, rules, mutations = suite(spark)
    good = frame(spark, ddl, rows)
    assert violations(good, rules).collect() == []
    assert len(mutations) >= 3
    for m in mutations:
        assert not violations(frame(spark, ddl, [rows[0] | m, *rows[1:]]), rules).isEmpty(), m
    if any(r.kind == "key" for r in rules):
        assert not violations(good.union(good), rules).isEmpty()
