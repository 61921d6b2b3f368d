"""Sums, residuals and exact numbers over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, exact
from ..operators import identity, joins, reconcile
from .registry import query, table

MONEY = "decimal(18,2)"


def money(c: str):
    return F.col(c).cast(MONEY)


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return reconcile.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
select count(distinct event_id) as ids, (select count(*) from (select distinct user_id, nullif(event_type, 'error') from events)) as pairs,
  (select count(*) from (select distinct nullif(event_type, 'error') from events)) as types from events
""")
def distinct_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null is a value of a tuple."""
    e = table(spark, sf_dir, "events").withColumn("kind", F.nullif("event_type", F.lit("error")))
    return reconcile.distinct_counts(e, ids=["event_id"], pairs=["user_id", "kind"], types=["kind"])


@query("""
select c_mktsegment, cast(sum(cast(o_totalprice as decimal(18, 2))) as varchar) as total, count(*) as n_parts, count(*) as n_known
from orders join customer on o_custkey = c_custkey group by c_mktsegment
""")
def exact_cents_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    rows = joins.label(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, sf_dir, "customer"), ["c_custkey"], ["c_mktsegment"])
    return reconcile.exact_total(rows.where("c_mktsegment is not null"), ["c_mktsegment"], money("o_totalprice")).withColumn("total", F.col("total").cast("string"))


def order_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), money("l_extendedprice").alias("price"))
    return reconcile.residuals(lines, table(spark, sf_dir, "orders").select("o_orderkey", money("o_totalprice").alias("printed")), ["o_orderkey"], "price", "printed")


RESIDUAL = """
with parts as (select l_orderkey as o_orderkey, sum(cast(l_extendedprice as decimal(18, 2))) as part_sum from lineitem group by all),
residuals as (
  select o_orderkey, part_sum, part_sum - cast(o_totalprice as decimal(18, 2)) as residual,
    case when part_sum is null then 'insufficient_evidence' when part_sum = cast(o_totalprice as decimal(18, 2)) then 'explained' else 'flagged_unreviewed' end as status
  from orders left join parts using (o_orderkey))
"""


@query(RESIDUAL + "select o_orderkey, cast(part_sum as varchar) as part_sum, cast(residual as varchar) as residual, status from residuals")
def component_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: what is left between an order's lines and its printed total."""
    r = order_residuals(spark, sf_dir)
    return r.select("o_orderkey", F.col("part_sum").cast("string").alias("part_sum"), F.col("residual").cast("string").alias("residual"), "status")


@query(RESIDUAL + "select s.status, count(residuals.status) as n from (values ('flagged_unreviewed'), ('explained'), ('insufficient_evidence')) as s(status) left join residuals on residuals.status = s.status group by s.status")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros stay."""
    return identity.report(order_residuals(spark, sf_dir))


@query("""
select (year(o_orderdate - interval 3 month)) || '-' || lpad(cast((year(o_orderdate - interval 3 month) + 1) % 100 as varchar), 2, '0') as fiscal_year,
  cast(cast(min(o_orderdate) as date) as varchar) as first_date, cast(cast(max(o_orderdate) as date) as varchar) as last_date, count(*) as n
from orders group by fiscal_year
""")
def fiscal_year_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A33."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    text = lambda c: c.cast("string")
    return o.groupBy(dates.fiscal_year(F.col("day")).alias("fiscal_year")).agg(text(F.min("day")).alias("first_date"), text(F.max("day")).alias("last_date"), F.count("*").alias("n"))


@query("""
with paid as (select distinct cast(o_orderdate as date) as day from orders where day(o_orderdate) in (1, 15)),
months as (select cast(year(day) as int) as year, date_trunc('month', day) as month, count(*) as n from paid group by all)
select year, cast(sum(n) as bigint) as n_dates, count(*) as n_months, sum(n) = 24 and count(*) = 12 and bool_and(n = 2) as full_year from months group by year
""")
def full_year_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two payment dates in each of twelve months."""
    paid = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).where("day(day) in (1, 15)").distinct().withColumn("year", F.year("day"))
    return reconcile.full_year(paid, ["year"], "day").select("year", "n_dates", "n_months", "full_year")


@query("""
select lang, case when count(*) = count(quality) then cast(cast(sum(quality) as bigint) as varchar) end as total, count(*) as n_parts, count(quality) as n_known
from documents left join (select doc_id, max(quality) as quality from labels group by doc_id) using (doc_id) group by lang
union all select 'labelled', cast(cast(sum(quality) as bigint) as varchar), count(*), count(quality) from (select doc_id, max(quality) as quality from labels group by doc_id)
""")
def missing_not_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum over missing parts is no sum."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    every = docs.select("lang", "quality").union(labels.select(F.lit("labelled"), "quality"))
    return reconcile.exact_total(every, ["lang"], F.col("quality").cast("long")).withColumn("total", F.col("total").cast("string"))


@query("""
with t as (select lang, cast(sum(quality) as bigint) as part, count(*) as whole from documents join labels using (doc_id) group by lang),
p as (select *, cast(round(100.0 * part / whole) as bigint) + case when lang in ('de', 'es') then 1 else 0 end as percent from t)
select lang, percent, abs(percent * whole - part * 100) * 2 <= whole as holds from p
""")
def rounded_percent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed percentages, one point too high for two of the languages."""
    t = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").cast("long").alias("part"), F.count("*").alias("whole"))
    t = t.withColumn("percent", F.round(F.col("part") * 100 / F.col("whole")).cast("long") + F.when(F.col("lang").isin("de", "es"), 1).otherwise(0))
    return t.select("lang", "percent", exact.rounded_percent_holds(F.col("percent"), F.col("part"), F.col("whole")).alias("holds"))


@query("""
select c_nationkey, count(*) as n_rows, count(*) filter (v < 0) as n_negative, count(*) filter (v = 0) as n_zero, count(*) filter (v is null) as n_missing
from (select c_nationkey, case when c_custkey % 9 <> 0 then cast(c_acctbal as decimal(18, 2)) - 3000 end as v from customer) group by c_nationkey
""")
def sign_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    return reconcile.signs(table(spark, sf_dir, "customer"), ["c_nationkey"], F.when(F.col("c_custkey") % 9 != 0, money("c_acctbal") - 3000))


@query("""
with v as (select c_nationkey, c_mktsegment, sum(cast(c_acctbal as decimal(18, 2))) as value from customer group by all),
t as (select c_nationkey as k, count(*) as n from v group by c_nationkey)
select k as equation_id, case when k % 6 = 2 then null when k % 6 = 1 then '-0.01' else '0.00' end as residual,
  cast(case when k % 6 = 2 then 1 else 0 end as bigint) as n_missing, n + 1 as n_inputs
from t
""")
def equation_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: segments less total by nation; some totals are off by a cent, some missing."""
    v = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum(money("c_acctbal")).alias("value"))
    key = lambda s: F.concat_ws("/", F.col("c_nationkey").cast("string"), s)
    off = F.when(F.col("c_nationkey") % 6 == 1, F.lit("0.01").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
    totals = v.groupBy("c_nationkey").agg(F.sum("value").alias("s")).select("c_nationkey", F.when(F.col("c_nationkey") % 6 != 2, F.col("s") + off).alias("value"))
    values = v.select(key(F.col("c_mktsegment")).alias("id"), F.col("value").cast("decimal(32,2)").alias("value")).union(totals.select(key(F.lit("total")), F.col("value").cast("decimal(32,2)")))
    left = v.select(F.col("c_nationkey").alias("equation_id"), F.lit(0).alias("position"), key(F.col("c_mktsegment")).alias("input_id"), F.lit(1).alias("coefficient"))
    right = totals.select(F.col("c_nationkey").alias("equation_id"), F.lit(1).alias("position"), key(F.lit("total")).alias("input_id"), F.lit(-1).alias("coefficient"))
    out = reconcile.equations(left.union(right), values)
    return out.select("equation_id", F.col("residual").cast("string").alias("residual"), "n_missing", F.size("inputs").cast("long").alias("n_inputs"))


def nation_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A rule a nation: its segments' balances come to its total; faults are planted by nation."""
    v = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum(money("c_acctbal")).alias("value"))
    nation = F.col("c_nationkey")
    totals = v.groupBy("c_nationkey").agg(F.sum("value").alias("s")).select("c_nationkey", F.lit("total").alias("c_mktsegment"), (F.col("s") + F.when(nation % 5 == 1, F.lit("1.00").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))).alias("value"))
    every = v.select("c_nationkey", "c_mktsegment", F.col("value").cast("decimal(32,2)").alias("value")).union(totals.select("c_nationkey", "c_mktsegment", F.col("value").cast("decimal(32,2)")))
    total = F.col("c_mktsegment") == "total"
    id = F.concat_ws("/", nation.cast("string"), "c_mktsegment")
    facts = every.where("not (c_nationkey % 5 = 4 and c_mktsegment = 'BUILDING')").select(
        id.alias("id"), F.when(~(total & (nation % 5 == 2)), F.col("value").cast("string")).alias("value"), F.lit("reported").alias("availability"), F.lit("dollars").alias("unit"), F.lit(None).cast("string").alias("currency"),
        F.when(~((nation % 5 == 3) & total), F.concat(F.lit("nation-"), nation.cast("string"))).alias("scopeKey"), F.when(total, "printed_total").otherwise("component").alias("role"), F.col("c_mktsegment").alias("sourceFactId"), F.lit("table").alias("sourceLocator"),
        F.sha2(F.lit("artifact"), 256).alias("artifactSha256"), F.sha2(F.lit("snapshot"), 256).alias("sourceSnapshotSha256"), F.to_json(F.struct(F.lit("dataset_cell").alias("kind"), id.alias("rowId"), F.lit("balance").alias("field"))).alias("nativeCellLocator"),
        F.lit(None).cast("string").alias("financialBasisId"), F.lit(None).cast("boolean").alias("financialBasisVerified"),
    )
    term = F.struct(F.concat_ws("/", nation.cast("string"), "c_mktsegment").alias("factId"), F.lit(1).alias("coefficient"))
    left = v.groupBy("c_nationkey").agg(F.collect_list(term).alias("left"))
    rules = left.select(
        nation.cast("string").alias("id"), F.lit(1).alias("version"), F.lit("linear_identity").alias("operation"), F.lit("source_native_arithmetic").alias("mode"), "left",
        F.array(F.struct(F.concat(nation.cast("string"), F.lit("/total")).alias("factId"), F.lit(1).alias("coefficient"))).alias("right"),
        F.struct(F.concat(F.lit("nation-"), nation.cast("string")).alias("scopeKey"), F.lit("dollars").alias("unit"), F.lit("same_schedule_component_sum").alias("nativeArithmeticDeclaration"), (nation != 10).alias("mappingConfirmed"), F.lit(True).alias("componentSetComplete"), F.lit(None).cast("string").alias("financialBasisId")).alias("basis"),
    )
    return rules, facts


@query("""
with v as (select c_nationkey as k, c_mktsegment as s, sum(cast(c_acctbal as decimal(18, 2))) as value from customer group by all),
t as (select k, sum(value) as left_value, bool_or(s = 'BUILDING') as has_building from v group by k)
select cast(k as varchar) as rule_id,
  case when (k % 5 = 4 and has_building) or k % 5 in (2, 3) or k = 10 then 'insufficient_evidence' when k % 5 = 1 then 'flagged_unreviewed' else 'explained' end as status,
  case when k % 5 = 4 and has_building then 'missing fact' when k % 5 = 2 then 'missing observation' when k % 5 = 3 then 'mismatched scope,unknown scope' when k = 10 then 'mapping not established' else '' end as reasons,
  case when (k % 5 = 4 and has_building) or k % 5 in (2, 3) or k = 10 then null when k % 5 = 1 then '-1.00' else '0.00' end as residual,
  case when (k % 5 = 4 and has_building) or k % 5 in (2, 3) or k = 10 then null else cast(left_value as varchar) end as left_value
from t
""")
def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.6: all three statuses, with sorted reasons and a residual that keeps its places."""
    out = identity.run(*nation_rules(spark, sf_dir))
    return out.select("rule_id", "status", F.array_join("reasons", ",").alias("reasons"), "residual", "left_value")


@query("""
with v as (select c_nationkey as k, c_mktsegment as s, sum(cast(c_acctbal as decimal(18, 2))) as value from customer group by all),
t as (select k, sum(value) as left_value, bool_or(s = 'BUILDING') as has_building from v group by k),
r as (select k, left_value, case when k % 5 = 4 and has_building then ['missing fact'] else list_sort(list_filter([
  case when k % 5 = 2 then 'missing observation' end, case when k % 5 = 3 then 'mismatched scope' end, case when k % 5 = 3 then 'unknown scope' end, case when k = 10 then 'mapping not established' end,
  case when k % 7 = 3 then 'unknown currency' end, case when k % 7 = 4 then 'undeclared financial basis' end, case when k % 7 = 5 then 'unverified financial basis' end], lambda x: x is not null)) end as reasons from t)
select cast(k as varchar) as rule_id, case when len(reasons) > 0 then 'insufficient_evidence' when k % 5 = 1 then 'flagged_unreviewed' else 'explained' end as status, array_to_string(reasons, ',') as reasons,
  case when len(reasons) > 0 then null when k % 5 = 1 then '-1.00' else '0.00' end as residual from r
""")
def monetary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.6 in the monetary mode: a currency and a verified financial basis are needed too."""
    rules, facts = nation_rules(spark, sf_dir)
    k = F.split("id", "/")[0].cast("int")
    facts = facts.withColumn("currency", F.when(k % 7 != 3, "CAD")).withColumn("financialBasisId", F.when(k % 7 == 4, "other").otherwise("cash")).withColumn("financialBasisVerified", k % 7 != 5)
    rules = rules.withColumn("mode", F.lit("monetary_comparison")).withColumn("basis", F.col("basis").withField("financialBasisId", F.lit("cash")))
    out = identity.run(rules, facts)
    return out.select("rule_id", "status", F.array_join("reasons", ",").alias("reasons"), "residual")


@query("""
select c_custkey, case when c_custkey % 7 = 0 then 'source_dash' when c_custkey % 11 = 0 then 'blank' when c_custkey % 13 = 0 then 'malformed' else 'present' end as presence,
  case when c_custkey % 7 = 0 or c_custkey % 11 = 0 or c_custkey % 13 = 0 then null when c_acctbal < 0 then '-' else '' end || cast(abs(cast(c_acctbal as decimal(18, 2))) as varchar) as value
from customer
""")
def token_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed tokens such as ``(1,234.50)``, dashes and blanks; none of them is zero."""
    shown = F.format_number(F.abs(money("c_acctbal")), 2)
    k = F.col("c_custkey")
    token = F.when(k % 7 == 0, "-").when(k % 11 == 0, "").when(k % 13 == 0, "n/a").when(F.col("c_acctbal") < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    return table(spark, sf_dir, "customer").select("c_custkey", exact.source_token(token).alias("t")).select("c_custkey", "t.presence", "t.value")


@query("""
select o_orderkey, cast(round(o_totalprice * 100) as bigint) * 10 as scaled,
  regexp_replace(format('{:,}', cast(floor(o_totalprice) as bigint)), ' ', '') || right(cast(cast(o_totalprice as decimal(18, 2)) as varchar), 3) as shown,
  cast(round(o_totalprice * 100) as bigint) % 100 = 0 as whole from orders
""")
def scaled_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact scaling by a thousand, and thousands separators; a fraction of a dollar does not scale by one."""
    raw = money("o_totalprice").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", exact.scale_exact(raw, F.lit(1000)).alias("scaled"), exact.grouped(raw).alias("shown"), exact.scale_exact(raw, F.lit(1)).isNotNull().alias("whole"))


@query("""
select distinct year(o_orderdate) || '/' || lpad(cast((year(o_orderdate) + 1) % 100 as varchar), 2, '0') as label, year(o_orderdate) || '-04-01' as start, (year(o_orderdate) + 1) || '-03-31' as "end" from orders
""")
def fiscal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of fiscal years give their first and last day."""
    y = F.year("o_orderdate")
    label = F.concat(y.cast("string"), F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    b = dates.fiscal_bounds(F.col("label"))
    return table(spark, sf_dir, "orders").select(label.alias("label")).distinct().select("label", b["start"].cast("string").alias("start"), b["end"].cast("string").alias("end"))


@query("select p_partkey, cast(cast(round(cast(p_retailprice as decimal(18, 2)) * cast(0.125 as decimal(9, 6)), 2) as decimal(20, 2)) as varchar) as share from part")
def percent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    return table(spark, sf_dir, "part").select("p_partkey", reconcile.percent_lines(money("p_retailprice"), F.lit("0.125")).cast("string").alias("share"))


@query("""
with rec as (select l_orderkey as k, l_linenumber as ln, cast(min(year(l_shipdate)) as int) as y from lineitem group by all),
eq as (select o_orderkey as k, o_orderstatus as s, cast(year(o_orderdate) as int) as y, count(*) as n from orders join rec on rec.k = o_orderkey group by o_orderkey, s, year(o_orderdate)),
pos as (select eq.k, eq.n, eq.y as own, rec.y, ln, row_number() over (partition by eq.k order by case when s = 'F' then ln else -ln end) as p from eq join rec using (k)),
f as (select k, p, case when n > 6 then case when p = 0 then 'no graph' end when y <> own then 'other year' when ln <> p then case when ln <= n then 'swapped' else 'other label' end end as fault from pos
  union all select k, 0, case when n > 6 then 'no graph' end from eq)
select fault, count(*) as n, count(distinct k) as n_equations, cast(sum(p) as bigint) as positions from f where fault is not null group by fault
""")
def equation_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, cash-bridge: an order is an equation of its lines; a graph says which labels a sum of so many lines has, in order, all of the order's year."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.year("l_shipdate")).alias("fiscal_year"))
    lines = li.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("key"), "fiscal_year", "l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("fiscal_year"))
    place = F.when(F.col("o_orderstatus") == "F", F.col("l_linenumber")).otherwise(-F.col("l_linenumber"))
    listed = lines.drop("fiscal_year").join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("o_orderkey", "fiscal_year").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "id"))).alias("l"))
    equations = listed.select(F.col("o_orderkey").alias("equation_id"), F.concat(F.lit("sum of "), F.size("l").cast("string")).alias("kind"), "fiscal_year", F.transform("l", lambda x: x["id"]).alias("inputs"), F.concat(F.lit("total/"), F.col("o_orderkey").cast("string")).alias("output"))
    records = lines.select("id", "key", "fiscal_year").union(orders.select(F.concat(F.lit("total/"), F.col("o_orderkey").cast("string")), F.lit("total"), "fiscal_year"))
    graph = spark.range(1, 7).select(F.concat(F.lit("sum of "), F.col("id").cast("string")).alias("kind"), F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), lambda i: F.concat(F.lit("line "), i.cast("string"))).alias("inputs"), F.lit("total").alias("output"))
    faults = reconcile.graph_faults(equations, records, graph)
    return faults.groupBy("fault").agg(F.count("*").alias("n"), F.count_distinct("equation_id").alias("n_equations"), F.sum("position").alias("positions"))
