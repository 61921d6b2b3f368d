"""Exact joins and integrity over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, gates, joins
from ..functions.hashing import canonical_sha256, has_keys
from ..sources.sinks import evidence_export
from .registry import query, table


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name as label from lineitem
left join (select * from supplier where s_acctbal < 5000) on l_suppkey = s_suppkey
""")
def label_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with small balances are labelled; other lines keep null."""
    return labelled(spark, sf_dir, "s_acctbal < 5000")


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name as label from lineitem
left join (select * from supplier where s_acctbal >= 0) on l_suppkey = s_suppkey
""")
def label_enrichment_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 with suppliers labelled by their balance."""
    return labelled(spark, sf_dir, "s_acctbal >= 0")


def labelled(spark: SparkSession, sf_dir: str, known: str) -> DataFrame:
    """All lines, with the names of the suppliers that a condition lets in."""
    labels = table(spark, sf_dir, "supplier").where(known).select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("label"))
    return joins.label(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), labels, ["l_suppkey"], ["label"])


@query("""
with labels as (select s_suppkey + 1450 as id, s_nationkey as nation from supplier union all select s_suppkey + 1450, s_nationkey from supplier where s_suppkey < 3),
rows as (select c_custkey as id, c_nationkey as nation from customer)
select 'duplicate' as fault, cast(id as varchar) as key, 1 as n from labels group by id having count(*) > 1
union all select 'unmatched', cast(id as varchar), cast(count(*) as int) from labels where id not in (select id from rows) group by id
union all select 'differs', cast(labels.id as varchar), cast(count(*) as int) from labels join rows using (id) where labels.nation <> rows.nation group by labels.id
""")
def label_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates, labels without a row, and labels that disagree with theirs."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1450).alias("id"), F.col("s_nationkey").alias("nation"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return joins.label_faults(rows, s.union(s.where("id < 1453")), ["id"], ["nation"]).groupBy("fault", "key").agg(F.count("*").cast("int").alias("n"))


@query("select l_orderkey, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by l_orderkey")
def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order is not among the closed ones."""
    closed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return joins.orphans(table(spark, sf_dir, "lineitem"), ["l_orderkey"], closed, ["o_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("select c_custkey, coalesce(c_nationkey = s_nationkey, false) as agrees from customer left join supplier on c_custkey = s_suppkey")
def linked_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links hold only if the key is found and every dimension is known and equal."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return joins.linked(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), s, ["c_custkey"], ["c_nationkey"]).select("c_custkey", "agrees")


@query("""
with claims as (select o_custkey, count(*) as listed from orders where not (o_custkey % 3 = 0 and o_orderkey % 2 = 0) group by o_custkey),
members as (select o_custkey, count(*) as members from orders group by o_custkey)
select o_custkey, listed, members, listed = members as equal from claims join members using (o_custkey)
""")
def same_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that each customer's claim lists against those there are."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    claims = orders.where("not (o_custkey % 3 = 0 and o_orderkey % 2 = 0)").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    return joins.same_population(claims, orders, ["o_custkey"], "ids", "o_orderkey")


@query("""
select n_nationkey, case when n_nationkey % 4 <> 1 then 'admitted' when n_nationkey % 8 = 1 then 'failed' else 'left out' end as outcome from nation
""")
def receipt_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose review is accepted for their bytes; optional ones that fail are left out, required ones are named."""
    n = table(spark, sf_dir, "nation").withColumn("review_path", F.concat(F.lit("r/"), F.col("n_nationkey").cast("string"))).withColumn("data_sha", F.sha2("n_name", 256))
    entries = n.select("n_nationkey", "review_path", F.col("n_name").alias("review_id"), F.lit("2026-01-01").alias("reviewed_on"), "data_sha", (F.col("n_nationkey") % 8 == 1).alias("required"))
    accepted = n.select(F.col("review_path").alias("path"), F.lit("accepted").alias("status"), F.col("n_name").alias("evidence_id"), F.lit("2026-01-01").alias("reviewed_on"), F.when(F.col("n_nationkey") % 4 != 1, F.col("data_sha")).alias("sha"))
    kept, lost, failed = joins.receipts(entries, accepted)
    outcome = lambda df, name: df.select("n_nationkey", F.lit(name).alias("outcome"))
    return outcome(kept, "admitted").union(outcome(lost, "left out")).union(outcome(failed, "failed"))


@query("""
select c_mktsegment as bundle, 'accepted' as review, 'mid' as balance, 'customers' as scope, string_agg(c_name, ',' order by c_name) as ids
from customer where c_acctbal between 4000 and 4400 group by c_mktsegment
""")
def evidence_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4."""
    c = table(spark, sf_dir, "customer")
    hits = c.where("c_acctbal between 4000 and 4400").select(F.col("c_mktsegment").alias("bundle"), F.col("c_name").alias("id"))
    bundles = hits.select("bundle").distinct().withColumn("review", F.lit("accepted"))
    out = evidence_export(bundles, hits, {"balance": "mid"}, "customers")
    return out.select("bundle", "review", F.col("filters")["balance"].alias("balance"), "scope", F.array_join("matchingRecordIds", ",").alias("ids"))


@query("""
with used as (select distinct o_orderkey as id, o_custkey from orders where o_orderstatus <> 'O')
select 'facts' as part, count(*) as n from used
union all select 'evidence', count(distinct o_custkey) from used
union all select 'sources', count(distinct c_nationkey) from used join customer on c_custkey = o_custkey
""")
def case_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: cases bring along the facts, evidence and sources that they rest on."""
    return closed(spark, sf_dir, "o_orderstatus <> 'O'")


@query("""
with used as (select distinct o_orderkey as id, o_custkey from orders where o_orderstatus = 'P')
select 'facts' as part, count(*) as n from used
union all select 'evidence', count(distinct o_custkey) from used
union all select 'sources', count(distinct c_nationkey) from used join customer on c_custkey = o_custkey
""")
def case_closure_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5 over all pending orders."""
    return closed(spark, sf_dir, "o_orderstatus = 'P'")


def closed(spark: SparkSession, sf_dir: str, pending: str) -> DataFrame:
    """Sizes of what the cases of chosen orders, one a customer, bring along."""
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    cases = orders.where(pending).groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("fact_ids")).withColumn("evidence_ids", F.array("id"))
    facts = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("evidence_id"))
    evidence = customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("source_id"))
    parts = catalog.closure(cases, facts, evidence, nations.select(F.col("n_nationkey").cast("long").alias("id")))
    count = lambda p: parts[p].agg(F.lit(p).alias("part"), F.count("*").alias("n"))
    return count("facts").union(count("evidence")).union(count("sources"))


@query("""
select 'closed_keys' as rule_id, count(*) as n_rows, count(*) filter (json_keys(props) <> ['k']) as n_broken from events
union all select 'known_type', count(*), count(*) filter (event_type not in ('click', 'view', 'purchase')) from events
union all select 'positive', count(*), count(*) filter (not value > 1) from events
""")
def gate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All row rules of a suite in one aggregation."""
    rules = [gates.row("closed_keys", has_keys(F.col("props"), "k")), gates.row("known_type", F.col("event_type").isin("click", "view", "purchase")), gates.row("positive", F.col("value") > 1)]
    return gates.profile(table(spark, sf_dir, "events"), rules)


@query("""
select 'line_unique' as rule_id, count(*) as n from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
union all select 'part_known', count(*) from lineitem where l_partkey not in (select p_partkey from part where p_size > 1)
union all select 'quantity', count(*) from lineitem where l_quantity > 48
union all select 'ordered', count(*) from (select 1 from lineitem group by l_orderkey having max(l_linenumber) > 6)
""")
def gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, FK, row and group rules of one suite."""
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    rules = [
        gates.key("line_unique", "l_orderkey", "l_linenumber"), gates.fk("part_known", ["l_partkey"], table(spark, sf_dir, "part").where("p_size > 1"), ["p_partkey"]),
        gates.row("quantity", F.col("l_quantity") <= 48), gates.group("ordered", F.max("l_linenumber") <= 6, "l_orderkey"), gates.agg("some", F.count("*") > 0),
    ]
    return gates.violations(lines, rules).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("select event_id, sha256(replace(props, ' ', '')) as sha from events")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of canonical JSON."""
    return table(spark, sf_dir, "events").select("event_id", canonical_sha256(F.col("props")).alias("sha"))
