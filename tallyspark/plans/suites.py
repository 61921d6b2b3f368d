"""The suites of all collections over the test tables, with faults planted by remainders of their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import collections as suites
from ..operators.gates import violations
from .registry import query, spread, table


def broken(df: DataFrame, rules, id: str = "id") -> DataFrame:
    return violations(df, rules, id).groupBy("rule_id").agg(F.count("*").alias("n"))


def counts(source: str, key: str, /, **faults: int | str) -> str:
    """SQL that counts rows by rule: those whose key has no remainder by a number, or that meet a condition."""
    parts = [f"select '{rule}' as rule_id, count(*) as n from {source} where {f'{key} % {by} = 0' if isinstance(by, int) else by} having count(*) > 0" for rule, by in faults.items()]
    return " union all ".join(parts)


def planted(k: Column, good: Column, **faults) -> Column:
    """``good``, but another value where the key has no remainder by a number: ``m31=value``."""
    out = good
    for by, value in faults.items():
        out = F.when(k % int(by[1:]) == 0, value).otherwise(out)
    return out


def text(c: str) -> Column:
    return F.col(c).cast("string")


@query(counts("customer", "c_custkey", stage=31, currency=37, unit=41, value=43, basis=47, evidence=53, same_source=53))
def foundation_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the foundation: stages, units, exact values, dimensions and their evidence."""
    k = F.col("c_custkey")
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.cast("string").alias("id"), planted(k, F.lit("audited_actual"), m31="planned").alias("stage"), planted(k, F.lit("CAD"), m37="USD").alias("currency"), F.lit("CAD_thousands").alias("unit"), planted(k, F.lit(1000), m41=1).alias("multiplier"),
        F.lit("flow").alias("measure_type"), F.lit("2024-04-01").alias("period_start"), F.lit("2025-03-31").alias("period_end"), F.lit(None).cast("string").alias("period_as_of"), F.lit("2024-25").alias("period_label"), planted(k, F.col("c_acctbal").cast("int").cast("string"), m43="1,000").alias("raw_value"),
        planted(k, F.lit("cash"), m47="").alias("accounting_basis"), F.lit("all").alias("reporting_perimeter"), F.lit("p. 1").alias("source_locator"), planted(k, F.col("n_nationkey"), m53=99).alias("evidence_id"), F.col("n_regionkey").alias("source_id"),
    )
    evidence = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("source_id"))
    return broken(rows, suites.foundation(evidence, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))))


@query(counts("orders", "o_orderkey", label=31, observation=37, not_aggregation_allowed=41))
def supplier_labels_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier labels: one for each observation, without a claim of identity."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(k.alias("id"), k.alias("observation_id"), planted(k, text("o_custkey"), m37="x").alias("source_row_id"), planted(k, text("o_custkey"), m31=" ").alias("supplier_label"), F.lit(False).alias("identity_resolved"), F.lit(False).alias("legal_entity_verified"), F.lit(False).alias("payment_evidence"), (k % 41 == 0).alias("aggregation_allowed"))
    return broken(rows, suites.suppliers(orders.select(k.alias("id"), text("o_custkey").alias("source_row_id"))))


@query(counts("customer", "c_custkey", measures=31, values=37, currency_unknown=41, multiplier_unknown=43))
def municipal_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Municipal rows: a closed map of measures, present or missing."""
    k = F.col("c_custkey")
    m = lambda presence, value: F.struct(F.lit(presence).alias("presence"), F.lit(value).cast("string").alias("rawValue"))
    good = F.create_map(F.lit("a"), m("present", "-1.5"), F.lit("b"), m("missing", None))
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.col("c_name").alias("municipality"), F.col("c_mktsegment").alias("municipality_type"), F.lit("2024-25").alias("fiscal_year"),
        F.when(k % 31 == 0, F.create_map(F.lit("a"), F.when(k % 37 == 0, m("present", None)).otherwise(m("present", "2")))).when(k % 37 == 0, F.create_map(F.lit("a"), m("present", None), F.lit("b"), m("missing", None))).otherwise(good).alias("measures"),
        F.when(k % 41 == 0, "CAD").alias("currency"), F.when(k % 43 == 0, 1).alias("multiplier"),
    )
    return broken(rows, suites.municipal(["a", "b"]))


@query(counts("customer", "c_custkey", role=31, no_placeholder=37, values="c_custkey % 41 = 0 and c_custkey % 43 <> 0", columns=43))
def municipal_capital_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capital rows: a role, no placeholders, values with dates as their kind says."""
    k = F.col("c_custkey")
    v = lambda kind, available, value, as_of: F.struct(F.lit(kind).alias("measureType"), F.lit(available).alias("availability"), F.lit(value).alias("value"), F.lit(as_of).cast("string").alias("asOf"))
    stock, flow, bad = v("stock", "reported", "1", "2022-03-31"), v("period_movement", "reported", "2", None), v("period_movement", "missing", "2", None)
    values = F.when(k % 43 == 0, F.array(stock)).when(k % 41 == 0, F.array(stock, bad)).otherwise(F.array(stock, flow))
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), planted(k, F.when(k % 2 == 0, "municipality").otherwise("published_aggregate"), m31="both").alias("row_role"), (k % 37 == 0).alias("is_placeholder"), values.alias("values"))
    return broken(rows, suites.municipal_capital(2))


@query(counts("orders", "o_orderkey", presence=31, token_value=37, column=41, unit=43, not_payment_evidence=47))
def budget_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget cells: the token, its presence and its value say the same, and a column fixes year and stage."""
    k, dash = F.col("o_orderkey"), F.col("o_orderkey") % 5 == 0
    rows = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), F.col("o_orderpriority").alias("table"), F.lit(1).alias("column_index"), planted(k, F.lit("2024-25"), m41="1999-00").alias("fiscal_year"), F.lit("original_estimate").alias("stage"),
        F.when(dash, "---").otherwise(F.format_string("(%,d)", F.col("o_custkey"))).alias("raw_token"), planted(k, F.when(~dash, F.concat(F.lit("-"), text("o_custkey"))), m37="0").alias("raw_value"),
        planted(k, F.when(dash, "source_dash").otherwise("present"), m31="blank").alias("presence"), F.lit("CAD_thousands").alias("unit"), planted(k, F.lit(1000), m43=1).alias("multiplier"), (k % 47 == 0).alias("payment_evidence"),
    )
    columns = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("table"), F.lit(1).alias("column_index"), F.lit("2024-25").alias("fiscal_year"), F.lit("original_estimate").alias("stage")).distinct()
    return broken(rows, suites.budget(columns))


@query(counts("orders", "o_orderkey", fiscal_year=31, presence_kind=37, presence=37, multiplier=41, not_future_payment=43))
def transfers_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments: dates in their fiscal year, cells blank or present."""
    k, blank = F.col("o_orderkey"), F.col("o_orderkey") % 5 == 0
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), text("o_custkey").alias("jurisdiction"), text("o_orderkey").alias("program_code"), F.date_format(day, "yyyy-MM-dd").alias("payment_date"), planted(k, dates.fiscal_year(day), m31="1900-01").alias("fiscal_year"),
        F.when(blank, "").otherwise("10").alias("raw_token"), F.when(~blank, "10").alias("raw_value"), planted(k, F.when(blank, "blank").otherwise("present"), m37="source_dash").alias("presence"), planted(k, F.lit(1), m41=2).alias("multiplier"), (k % 43 == 0).alias("future_payment"),
    )
    return broken(rows, suites.transfers())


@query(counts("(select distinct l_orderkey from lineitem)", "l_orderkey", sum=31, count=37))
def transfer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of a program's year come to the printed sum and number."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("program_code"), F.lit("2024").alias("fiscal_year"), F.col("l_quantity").cast("int").alias("q"))
    lines, k = spread(lines, "program_code"), F.col("program_code")  # all that follows keeps a program's lines together
    printed = lines.groupBy("program_code").agg((F.sum("q") + F.when(k % 31 == 0, 1).otherwise(0)).cast("string").alias("reported_sum"), (F.count("*") + F.when(k % 37 == 0, 1).otherwise(0)).alias("date_count"))
    rows = lines.join(printed, "program_code").withColumn("raw_value", text("q")).withColumn("id", k.cast("string"))
    return broken(rows, suites.transfer_summaries())


@query(counts("customer", "c_custkey", role=31, start=37, end=41, token_value=43))
def institution_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement cells: a label fixes its role, and flows span their fiscal year."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.col("c_mktsegment").alias("label"), planted(k, F.lit("component"), m31="total").alias("aggregation_role"), F.lit("flow").alias("measure_type"), F.lit("2024-25").alias("fiscal_year"), planted(k, F.lit("2024-04-01"), m37="2024-05-01").alias("period_start"),
        planted(k, F.lit("2025-03-31"), m41="2025-12-31").alias("period_end"), F.lit(None).cast("string").alias("period_as_of"), F.lit("1,234").alias("raw_token"), planted(k, F.lit("1234"), m43="1,234").alias("raw_value"), F.lit("present").alias("presence"),
    )
    return broken(rows, suites.institution(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("label"), F.lit("component").alias("aggregation_role")).distinct()))


@query(counts("customer", "c_custkey", term_known=31, sign=37, residual_zero="c_custkey % 31 = 0 or c_custkey % 37 = 0 or c_custkey % 41 = 0"))
def equation_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed terms of an equation come to zero, none missing (cash bridge, capital explanation, approvals)."""
    k = F.col("c_custkey")
    term = lambda name, sign, value: F.struct(F.lit(name).alias("term"), sign.alias("coefficient"), value.alias("value"))
    terms = F.array(term("a", planted(k, F.lit(1), m37=2), F.lit(10)), term("b", F.lit(1), F.when(k % 31 != 0, 5)), term("c", F.lit(-1), planted(k, F.lit(15), m41=14)))
    rows = table(spark, sf_dir, "customer").select(k.alias("equation"), F.inline(terms)).withColumn("id", F.concat_ws("-", text("equation"), "term"))
    return broken(rows, suites.balanced(["equation"]))


@query(counts("lineitem", "l_orderkey", id_composed=37, order=41) + " union all " + counts("(select distinct l_orderkey from lineitem)", "l_orderkey", order_total=31))
def authorizations_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of orders, their composed ids and the printed totals."""
    k = F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", k.cast("string").alias("order_number"), text("l_linenumber").alias("clause"), F.col("l_quantity").cast("int").alias("q"))
    lines = lines.withColumn("clause", F.concat_ws(".", "clause", F.row_number().over(Window.partitionBy("l_orderkey", "clause").orderBy("q"))))
    totals = lines.groupBy("l_orderkey").agg((F.sum("q") + F.when(k % 31 == 0, 1).otherwise(0)).cast("string").alias("reported_total"))
    rows = lines.join(totals, "l_orderkey").withColumn("raw_value", text("q")).withColumn("id", F.concat(F.concat_ws("-", "order_number", "clause"), F.when(k % 37 == 0, "x").otherwise("")))
    return broken(rows, suites.authorizations(table(spark, sf_dir, "lineitem").where(k % 41 != 0).select(k.cast("string").alias("order_number")).distinct()))


@query(counts("orders", "o_orderkey", clause=31))
def purpose_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purpose names one clause of one order."""
    clauses = table(spark, sf_dir, "orders").select(text("o_custkey").alias("order_number"), text("o_orderkey").alias("id"), F.col("o_orderpriority").alias("clause"))
    rows = table(spark, sf_dir, "orders").select(text("o_orderkey").alias("id"), text("o_custkey").alias("order_number"), text("o_orderkey").alias("record_id"), planted(F.col("o_orderkey"), F.col("o_orderpriority"), m31="9").alias("clause"))
    return broken(rows, suites.purpose(clauses))


@query(counts("customer", "c_custkey", footnote="c_custkey % 31 = 0 or c_custkey % 37 = 0"))
def governance_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order and the footnote it answers, by number, program, portfolio and digest."""
    base = table(spark, sf_dir, "customer").select(text("c_custkey").alias("id"), text("c_custkey").alias("order_number"), F.col("c_name").alias("program"), F.col("c_mktsegment").alias("portfolio"), F.sha2("c_name", 256).alias("pdf_sha"), "c_custkey")
    rows = base.withColumn("portfolio", planted(F.col("c_custkey"), F.col("portfolio"), m31="x")).withColumn("pdf_sha", F.when(F.col("c_custkey") % 37 != 0, F.col("pdf_sha")))
    return broken(rows, suites.governance(base.drop("c_custkey", "id")))


@query(counts("customer", "c_custkey", calculated=31, residual="c_custkey % 31 = 0 or c_custkey % 37 = 0", profile_untouched=41))
def reporting_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources on one year; the rounded profile is never subtracted."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), F.lit("10.00").alias("operating"), F.lit("-5.25").alias("financing"), planted(k, F.lit("4.75"), m31="4.76").alias("calculated"), F.lit("4.00").alias("reported"), planted(k, F.lit("0.75"), m37="0.74").alias("residual"), F.when(k % 41 == 0, "0").alias("profile_difference"))
    return broken(rows, suites.reporting())


@query("""
with y as (select 2021 + c_custkey % 4 as y from customer)
select 'cohort_sum' as rule_id, count(distinct y) as n from y where y = 2022 having n > 0 union all select 'main_completed', 1
""")
def audit_cohorts_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts of the main years, one of them with a total too large, and a main sum that is printed wrong."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), (k % 4 + 2021).alias("audit_year"), (k % 7).alias("completed"), (k % 5).alias("not_completed")).withColumn("total", F.col("completed") + F.col("not_completed"))
    main = F.col("audit_year") < 2024
    cohorts = base.where(main).groupBy("audit_year").agg(F.sum("completed").alias("cohort_completed"), (F.sum("total") + F.when(F.col("audit_year") == 2022, 1).otherwise(0)).alias("cohort_total"))
    printed = base.where(main).agg((F.sum("completed") + 1).alias("main_completed"), F.sum("not_completed").alias("main_not_completed"), F.sum("total").alias("main_total")).first()  # one row
    rows = base.join(F.broadcast(cohorts), "audit_year", "left").withColumns({name: F.lit(value) for name, value in printed.asDict().items()})
    return broken(rows, suites.audit_cohorts((2021, 2022, 2023), 2024))


@query("""
with r as (select n_nationkey as k, r_name as a, row_number() over (partition by r_name order by n_nationkey) as n from nation join region on r_regionkey = n_regionkey)
select 'page' as rule_id, count(*) as n from r where k % 7 = 3 union all select 'pdf_page', count(*) from r where k % 7 = 3
union all select 'status_set', count(*) from r where k % 5 = 4 union all select 'id_composed', count(*) from r where k % 11 = 5
""")
def recommendations_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations on the page, with the status and the id that their number says."""
    k = F.col("n_nationkey")
    r = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("number", F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey")))
    n = F.col("number")
    page = F.when(n <= 3, 4).otherwise(5)
    done = (n <= 2) != (k % 5 == 4)
    rows = r.select(F.concat(F.lit("y-"), "r_name", F.lit("-"), F.lpad(n.cast("string"), 2, "0"), F.when(k % 11 == 5, "x").otherwise("")).alias("id"), F.col("r_name").alias("audit_id"), "number", F.when(done, "Completed").otherwise("Incomplete").alias("status"), (page + F.when(k % 7 == 3, 2).otherwise(0)).alias("printed_page"), (page + 1).alias("pdf_page"), F.lit(False).alias("current_status_verified"))
    names = [x["r_name"] for x in table(spark, sf_dir, "region").collect()]  # five rows
    return broken(rows, suites.audit_recommendations({a: [(3, 4), (9, 5)] for a in names}, {a: [1, 2] for a in names}, "y-"))


@query("select 'total_b' as rule_id, 1 as n from (select count(*) from customer)")
def column_totals_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each column come to its printed total, which is wrong for one."""
    parts = table(spark, sf_dir, "customer").select(text("c_custkey").alias("id"), F.col("c_custkey").alias("a"), F.col("c_nationkey").cast("long").alias("b"), F.lit(False).alias("is_total"))
    total = parts.agg(F.lit("total").alias("id"), F.sum("a").alias("a"), (F.sum("b") + 1).alias("b"), F.lit(True).alias("is_total"))
    return broken(parts.union(total), suites.column_totals(["a", "b"]))


@query("select 'group_count' as rule_id, count(*) as n from region where r_regionkey % 3 = 1")
def facilities_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities of a group come to its count."""
    n = table(spark, sf_dir, "nation").select(text("n_nationkey").alias("id"), F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").cast("long").alias("facility_count"))
    groups = n.groupBy("group_id").agg((F.sum("facility_count") + F.when(F.col("group_id") % 3 == 1, 1).otherwise(0)).alias("group_count"))
    return broken(n.join(F.broadcast(groups), "group_id"), suites.facilities())


@query(counts("nation", "n_nationkey", cells="n_nationkey % 7 = 2", cells_complete="n_nationkey % 7 in (1, 2)", no_combined_rate="n_nationkey % 7 = 3"))
def winter_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal cells are the expected ones, none missing, and no rate combines them."""
    k = F.col("n_nationkey")
    expected = table(spark, sf_dir, "nation").select(k.cast("string").alias("id"), text("n_regionkey").alias("group_id"), F.col("n_name").alias("cell"))
    rows = table(spark, sf_dir, "nation").where(k % 7 != 1).select(k.cast("string").alias("id"), text("n_regionkey").alias("group_id"), F.when(k % 7 == 2, "other").otherwise(F.col("n_name")).alias("cell"), F.when(k % 7 == 3, 0.5).alias("combined_rate"))
    return broken(rows, suites.winter(expected))


@query("""
select 'alias' as rule_id, count(*) as n from nation join region on r_regionkey = n_regionkey where r_name = 'ASIA' having n > 0
union all select 'cell_kind', count(*) from nation where n_nationkey % 7 = 4
""")
def anonymous_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Housing and ambulance: agreed aliases only; a cell is not applicable, a rate or an amount."""
    k = F.col("n_nationkey") % 3
    r = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.when(F.col("n_nationkey") % 7 == 4, "text").when(k == 0, "not_applicable").when(k == 1, "rate").otherwise("amount")
    rows = r.select(text("n_nationkey").alias("id"), F.col("r_name").alias("alias"), F.when(k == 0, "N/A").when(k == 1, "12.5%").otherwise("$1,200").alias("cell"), kind.alias("kind"))
    return broken(rows, suites.anonymous_case(["AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"]))


@query(counts("customer", "c_custkey", currency_unknown=31, no_motion=37, not_settlement_verified=41))
def grants_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: exact cents without a currency; the residual to the printed total is disclosed."""
    k = F.col("c_custkey")
    v = F.abs(F.col("c_acctbal").cast("decimal(18,2)"))
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), v.cast("string").alias("reported_amount"), F.when(k % 31 == 0, "CAD").alias("currency"), (k % 41 == 0).alias("settlement_verified"), F.when(k % 37 == 0, "M1").alias("official_motion_id"), F.lit(-5).cast("decimal(38,2)").alias("disclosed_residual"))
    printed = table(spark, sf_dir, "customer").agg((F.sum(v) + 5).cast("decimal(38,2)")).first()[0]  # one number
    return broken(rows, suites.grants(F.lit(printed).cast("decimal(38,2)")))


@query(counts("orders", "o_orderkey", month=31, amount=37))
def register_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: cheques of one month with exact cents."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), text("o_custkey").alias("chequebook_id"), k.cast("string").alias("cheque_number"), F.col("o_orderpriority").alias("section"), planted(k, F.lit("12.50"), m37="12.5").alias("reported_amount"), planted(k, F.lit("2026-01-31"), m31="2026-02-01").alias("cheque_date"))
    return broken(rows, suites.register())


@query(counts("customer", "c_custkey", under=31, over_unknown=37, matters=41))
def water_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is printed as under budget is the difference; the blank column is unknown."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), k.alias("spent"), (k + F.col("c_nationkey")).alias("budget"), (-F.col("c_nationkey") + F.when(k % 31 == 0, 1).otherwise(0)).alias("under"), F.when(k % 37 == 0, 0).alias("over"), F.when(k % 41 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("M1"))).alias("matter_ids"))
    return broken(rows, suites.water())


@query("""
select 'net' as rule_id, 1 as n from customer having count(*) filter (c_custkey % 2 = 0) > 0
union all select 'projects', 1 from customer having count(*) filter (c_custkey % 2 = 1) > 0
""")
def water_services_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20 by service: spent, budget and net against the calculated and the narrated sums, the projects by id."""
    k = F.col("c_nationkey")
    p = table(spark, sf_dir, "nation").select(text("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "water").otherwise("wastewater").alias("service_group"), F.col("n_nationkey").cast("long").alias("spent"), (F.col("n_nationkey") * 2).cast("long").alias("budget"))
    wet = F.col("service_group") == "water"
    told = p.groupBy("service_group").agg(F.sum("spent").alias("calculated_spent"), F.sum("spent").alias("narrated_spent"), F.sum("budget").alias("calculated_budget"), F.sum(F.col("budget") - F.col("spent")).alias("calculated_net"), F.collect_list(F.when(wet | (F.col("id") != "1"), F.col("id"))).alias("project_ids"))
    told = told.withColumn("narrated_net", F.col("calculated_net") + F.when(wet, 1).otherwise(0)).withColumn("is_additional_money", F.lit(False))
    return broken(p.join(F.broadcast(told), "service_group"), suites.water_services())


@query(counts("customer", "c_custkey", difference=31, object=37))
def transit_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual less planned; objects equal the reviewed ones."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), k.alias("actual"), (k * 2).alias("planned"), (-k + F.when(k % 31 == 0, 1).otherwise(0)).alias("difference"), F.col("c_name").alias("canonical"), planted(k, F.col("c_name"), m37="x").alias("reviewed"))
    return broken(rows, suites.transit())


@query("select 'planned_parts' as rule_id, 1 as n from (select count(*) from nation)")
def transit_total_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall row is one less than its parts, which is disclosed; the planned parts are printed wrong."""
    parts = table(spark, sf_dir, "nation").select(text("n_nationkey").alias("id"), F.lit(False).alias("is_overall"), F.col("n_nationkey").cast("long").alias("actual"), F.col("n_regionkey").cast("long").alias("planned"))
    sums = parts.agg(F.sum("actual").alias("component_actual"), F.sum("planned").alias("p"))
    overall = sums.select(F.lit("all").alias("id"), F.lit(True).alias("is_overall"), (F.col("component_actual") - 1).alias("actual"), F.col("p").alias("planned"))
    printed = sums.select("component_actual", (F.col("p") + 1).alias("component_planned"), F.lit(1).cast("long").alias("disclosed_residual")).first()  # one row
    return broken(parts.union(overall).withColumns({name: F.lit(value) for name, value in printed.asDict().items()}), suites.transit_total())


@query(counts("part", "p_partkey", url=31, group=37))
def references_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References have safe addresses and a group."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.cast("string").alias("id"), planted(k, F.concat(F.lit("https://r.example/"), k.cast("string")), m31="javascript:x").alias("url"), planted(k, F.lit("guide"), m37="other").alias("group"))
    return broken(rows, suites.source_references())


@query("""
with g as (select c_nationkey as k, count(*) as n, count(distinct c_mktsegment) as d from customer group by all)
select 'recurring' as rule_id, count(*) as n from g where k % 5 = 2 having n > 0 union all select 'distinct', count(*) from g where k % 7 = 3 having count(*) > 0
""")
def methodology_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said to recur is what was counted."""
    k = F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("counted_recurring"), F.count_distinct("c_mktsegment").alias("counted_distinct"))
    rows = rows.select(k.cast("string").alias("id"), "counted_recurring", "counted_distinct", (F.col("counted_recurring") + (k % 5 == 2).cast("int")).alias("recurring_groups"), (F.col("counted_distinct") + (k % 7 == 3).cast("int")).alias("distinct_references"))
    return broken(rows, suites.methodology())


@query(counts("customer", "c_custkey", count=31, digest=37, route=41, not_complete_source_coverage=43, source=47))
def coverage_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory rows: counted, pinned, routed, without a claim to be complete."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), planted(k, F.lit(1), m31=0).alias("count"), planted(k, F.sha2("c_name", 256), m37="x").alias("data_sha"), planted(k, F.lit("#/find"), m41="/find").alias("route"), (k % 43 == 0).alias("complete_source_coverage"), F.lit(False).alias("scheduled_refresh"), planted(k, F.col("c_nationkey"), m47=99).alias("related_source_id"))
    return broken(rows, suites.coverage(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))))


@query(counts("customer", "c_custkey", stages=31, raw=37, scaled="c_custkey % 37 = 0 or c_custkey % 41 = 0"))
def comparisons_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of stages: the pair is known, the difference reproduces, raw and scaled."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), planted(k, F.lit("original_estimate"), m31="capital_plan").alias("before_stage"), F.lit("amended_estimate").alias("after_stage"), F.lit("10.5").alias("before"), F.lit("12.0").alias("after"), planted(k, F.lit("1.5"), m37="1.6").alias("difference"), F.lit(1000).alias("multiplier"),
        planted(k, F.lit(1500), m41=1).cast("long").alias("scaled_difference"),
    )
    return broken(rows, suites.comparisons())


@query(counts("customer", "c_custkey", predecessor=31, not_itself=37))
def superseding_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle that replaces another names it by digest, and both are kept."""
    k = F.col("c_custkey")
    earlier = table(spark, sf_dir, "customer").select(F.sha2("c_name", 256).alias("sha"))
    old = planted(k, F.sha2("c_name", 256), m31=F.sha2(F.concat("c_name", F.lit("?")), 256))
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), old.alias("supersedes_sha"), planted(k, F.sha2(F.concat("c_name", F.lit("2")), 256), m37=old).alias("sha"))
    return broken(rows, suites.superseding(earlier))


@query(counts("customer", "c_custkey", difference="c_custkey % 31 = 0 and c_custkey % 37 <> 0", missing_has_none=37))
def difference_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual less budget of each line, and no difference where an amount is missing."""
    k, v = F.col("c_custkey"), F.col("c_acctbal").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), F.when(k % 37 != 0, v.cast("string")).alias("actual"), F.lit("100.00").alias("budget"), (v - 100 + F.when(k % 31 == 0, 1).otherwise(0)).cast("decimal(18,2)").cast("string").alias("difference"))
    return broken(rows, suites.differences())
