"""Readiness and budget pages over the test tables; what is wrong follows from what the tables say, and the SQL works it out from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collections as suites
from ..operators import journal, readiness
from ..operators.gates import disjoint, violations
from .registry import parts, query, table


def sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line numbers of an order's returned lines, and those of its finished lines as expected, for urgent orders as text."""
    lines, number = table(spark, sf_dir, "lineitem"), F.col("l_linenumber").cast("string")
    observed = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("set"), number.alias("value"))
    urgent = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("set"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    expected = lines.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("set"), number.alias("n")).join(urgent, "set", "left")
    return observed, expected.select("set", F.when(F.col("urgent"), F.concat(F.lit('"'), "n", F.lit('"'))).otherwise(F.col("n")).alias("value"))


@query("""
with o as (select l_orderkey as k, cast(l_linenumber as varchar) as v, count(*) as n from lineitem where l_returnflag = 'R' group by all),
e as (select distinct l_orderkey as k, case when o_orderpriority = '1-URGENT' then '"' || l_linenumber || '"' else cast(l_linenumber as varchar) end as v from lineitem left join orders on l_orderkey = o_orderkey where l_linestatus = 'F')
select coalesce(o.k, e.k) as set, coalesce(o.v, e.v) as value, case when e.k is null then 'unexpected' when o.k is null then 'missing' else 'repeated' end as problem
from o full join e on o.k = e.k and o.v = e.v where e.k is null or o.k is null or o.n > 1
""")
def readiness_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: observed against expected sets with values of a kind."""
    return readiness.set_issues(*sets(spark, sf_dir))


@query("""
with l as (select l_orderkey as k, l_linenumber as i, max(l_partkey) as wanted, count(*) filter (not (l_returnflag = 'A' and l_linestatus = 'O')) as n,
  max(case when l_returnflag = 'R' then l_suppkey else l_partkey end) filter (not (l_returnflag = 'A' and l_linestatus = 'O')) as found from lineitem group by all)
select 'orders/' || k || '/' || i as path, case when n <> 1 then 'missing, not a regular file or too large' else 'pinned bytes changed' end as reason
from l join orders on k = o_orderkey where o_orderstatus <> 'P' and (n <> 1 or found <> wanted)
union all select 'orders/' || o_orderkey || '.json', 'pinned bytes changed' from orders where o_orderstatus = 'P' and o_orderkey in (select l_orderkey from lineitem)
""")
def readiness_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, J19: orders as pinned manifests of their lines; lines as files, some gone, some with other bytes, some there twice."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = parts(lines)
    path = lambda key, end: F.concat(F.lit("orders/"), F.col(key).cast("string"), end)
    file = lambda body: [F.lit("file").alias("kind"), F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("sha")]
    text = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).otherwise(F.col("l_partkey")).cast("string")
    there = lines.where("not (l_returnflag = 'A' and l_linestatus = 'O')").select(path("l_orderkey", F.concat(F.lit("/"), F.col("l_linenumber").cast("string"))).alias("path"), *file(text), F.lit(None).cast("string").alias("body"))
    manifest = F.lit(".json")
    dealt = lines.select(path("l_orderkey", manifest).alias("path"), "l_linenumber", "l_partkey").repartition(n, "path")  # by what manifests are joined on below
    listed = dealt.groupBy("path", "l_linenumber").agg(F.max("l_partkey").cast("string").alias("text"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("name"), F.sha2("text", 256).alias("sha"))))
    bodies = listed.groupBy("path").agg(F.to_json(F.struct(F.map_from_entries(entries).alias("files"))).alias("body"))
    manifests = bodies.select("path", *file(F.col("body")), "body")
    reviewed = manifests.join(orders.select(path("o_orderkey", manifest).alias("path"), "o_orderstatus"), "path")
    pins = reviewed.select("path", F.when(F.col("o_orderstatus") == "P", F.sha2("path", 256)).otherwise(F.col("sha")).alias("sha"))
    files = there.union(manifests.select(there.columns))
    bases = orders.select(path("o_orderkey", manifest).alias("path"), path("o_orderkey", F.lit("")).alias("base"))
    return readiness.pin_issues(files, readiness.manifest_pins(files, pins, bases), n)


def flags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A flag for each document, assigned where it has a label: on if toxic, the text "false" if poor."""
    rated = table(spark, sf_dir, "labels")
    value = F.when(F.col("toxic") == 1, "true").when(F.col("quality") == 0, '"false"').otherwise(" false ")
    of = lambda df, *more: df.select(F.col("doc_id").cast("string").alias("path"), F.lit("TRANSPORT").alias("name"), *more)
    return of(rated, value.alias("value")), of(table(spark, sf_dir, "documents"))


@query("""
select cast(d.doc_id as varchar) as path, 'TRANSPORT' as name, case when n is null then 'not assigned exactly once' else 'not disabled' end as reason
from (select distinct doc_id from documents) d left join (select doc_id, count(*) as n, max(toxic) as toxic, max(quality) as quality from labels group by doc_id) l on d.doc_id = l.doc_id
where n is null or toxic = 1 or quality = 0
""")
def readiness_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: flags that are on, of another kind than boolean, or not there."""
    return readiness.flag_issues(*flags(spark, sf_dir))


def bound(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as accepted baselines, with reviews and declarations that follow from their status and priority."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    baseline = F.to_json(F.struct(F.struct(F.lit("d").alias("datasetId"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("capturedAt")).alias("source"), F.array(F.col("o_custkey")).alias("records")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), baseline.alias("body"), priority.alias("priority"), status.alias("status"))
    named = F.when(F.col("priority") == "1-URGENT", F.sha2("name", 256)).otherwise(F.sha2("body", 256))
    rows = orders.withColumn("review", F.to_json(F.struct(F.when(F.col("status") == "P", "pending").otherwise("accepted").alias("status"), named.alias("bundleSha256"))))
    declared = rows.where("priority <> '5-LOW'").select("name", F.sha2("body", 256).alias("baseline_sha"), F.when(F.col("priority") == "2-HIGH", F.sha2("name", 256)).otherwise(F.sha2("review", 256)).alias("review_sha"))
    return orders.select("name", "body"), rows.select("name", F.col("review").alias("body")), declared


@query("""
select cast(o_orderkey as varchar) as name, concat_ws(', ', case when o_orderpriority = '5-LOW' then 'not one declaration' end, case when o_orderstatus = 'P' then 'review is not accepted' end, case when o_orderpriority = '1-URGENT' then 'review is of other bytes' end,
  case when o_orderpriority = '5-LOW' then 'declared baseline differs' end, case when o_orderpriority in ('2-HIGH', '5-LOW') then 'declared review differs' end) as problems from orders
""")
def readiness_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: baselines, their reviews and what is declared of both, bound to each other by digest."""
    return readiness.binding_problems(*bound(spark, sf_dir)).select("name", F.array_join("problems", ", ").alias("problems"))


@query("""
select cast(o_orderkey as varchar) as name, 1 as observations, strftime(o_orderdate + interval 7 days, '%Y-%m-%d %H:%M:%S') as floor from orders where o_orderstatus <> 'P' and o_orderpriority in ('3-MEDIUM', '4-NOT SPECIFIED')
""")
def baseline_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: where a bound baseline comes from, and the earliest time after it."""
    baselines, reviews, declared = bound(spark, sf_dir)
    found = readiness.provenance(baselines, readiness.binding_problems(baselines, reviews, declared))
    return found.select("name", "observations", F.date_format("floor", "yyyy-MM-dd HH:mm:ss").alias("floor"))


@query("""
select 'repository_drift_requires_review' as status, false as boundary_verified, false as collection_authorized, false as publication_allowed,
  (select count(*) from documents d left join labels l on d.doc_id = l.doc_id where l.doc_id is null or toxic = 1 or quality = 0) as flags,
  (select count(*) from orders where o_orderstatus = 'P' or o_orderpriority not in ('3-MEDIUM', '4-NOT SPECIFIED')) as bindings
""")
def readiness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: one row over all parts; nothing is authorised."""
    return readiness.report(flags=readiness.flag_issues(*flags(spark, sf_dir)), bindings=readiness.binding_problems(*bound(spark, sf_dir)).where(F.size("problems") > 0))


@query("""
select cast(page_id as varchar) as id, url, ['Access hold on ' || url] as statements from pages where contains(lower(html), 'the')
""")
def retained_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: the limitations of sources that speak of a hold, in their own words."""
    says = F.when(F.contains(F.lower("html"), F.lit("the")), F.concat(F.lit("Access hold on "), "url")).otherwise(F.concat(F.lit("Read "), "url"))
    return readiness.retained_holds(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), "url", F.array(F.lit("No licence"), says).alias("limitations")))


@query("""
select 'unknown_request_time' as code, count(*) as n from orders where o_orderstatus <> 'F'
""")
def request_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: receipts that do not tell when they were completed, or without an offset."""
    done = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    receipt = F.to_json(F.struct(F.lit("2026-01-01T00:00:00Z").alias("attemptedAt"), F.when(F.col("o_orderstatus") == "F", F.concat(done, F.lit("Z"))).when(F.col("o_orderstatus") == "O", done).alias("completedAt")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("snapshot"), F.lit("attempts/1/robots.receipt.json").alias("path"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("bytes"), F.lit("x").alias("sha"), receipt.alias("body"))
    return journal.findings(rows, parts=parts(rows)).where("code = 'unknown_request_time'").groupBy("code").agg(F.count("*").alias("n"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair of flags a table, on the pages of the quantities of its lines with discount."""
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.05")
    return lines.groupBy(F.concat("l_returnflag", "l_linestatus").alias("table")).agg(F.min("l_quantity").cast("int").alias("first_page"), F.median("l_quantity").cast("int").alias("last_page"))


@query("""
with r as (select l_returnflag || l_linestatus as t, min(l_quantity)::int as a, trunc(median(l_quantity))::int as z from lineitem where l_discount > 0.05 group by all)
select 'page' as rule_id, count(*) as n from lineitem join r on t = l_returnflag || l_linestatus where not (floor(l_quantity) between a and z) having count(*) > 0
union all select 'lines', 1 where (select count(distinct (l_returnflag || l_linestatus, l_partkey, l_suppkey)) from lineitem) <> 7
union all select 'not_latest_forecast_claim', count(*) from lineitem where l_tax > 0.07 having count(*) > 0
union all select 'same_pdf', count(*) from lineitem where l_linenumber = 7 having count(*) > 0
""")
def budget_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget gate: cells on the pages of their table, of the bundle's document, as many as the coverage says."""
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("table"), F.col("l_partkey").alias("section"), F.col("l_suppkey").alias("label"), F.floor("l_quantity").cast("int").alias("pdf_page"),
        F.when(F.col("l_tax") >= 0, "present").alias("presence"), (F.col("l_tax") > 0.07).alias("latest_forecast_claim"), F.when(F.col("l_linenumber") == 7, "other").otherwise("s").alias("source_pdf_sha"),
    )
    found = violations(cells, suites.budget_pages(page_ranges(spark, sf_dir), "s", lines=7))
    return found.groupBy("rule_id").agg(F.count("*").alias("n"))


@query("""
with r as (select l_suppkey as t, l_orderkey as k, min(l_quantity)::int as a, max(l_quantity)::int as z from lineitem group by all)
select distinct t as table, k as id from r x where exists (select 1 from r y where y.t = x.t and (y.a, y.z, y.k) < (x.a, x.z, x.k) and y.z >= x.a)
""")
def overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges of one document that start before an earlier one ends."""
    lines = table(spark, sf_dir, "lineitem")
    ranges = lines.groupBy(F.col("l_suppkey").alias("table"), F.col("l_orderkey").alias("id")).agg(F.min("l_quantity").cast("int").alias("first_page"), F.max("l_quantity").cast("int").alias("last_page"))
    return disjoint(ranges, ["table"], "first_page", "last_page", "id").select("table", "id")
