"""Files, reviews, suites and smaller operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, exact, text, urls
from ..operators import catalog, collections, identity, joins, journal, reconcile
from ..operators.gates import violations
from ..sources import pinned, sinks, strict_csv
from ..sources.frozen import scratch
from .registry import parts, query, table
from .searching import awards


def broken(df: DataFrame, rules, id: str = "id") -> DataFrame:
    return violations(df, rules, id).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("select cast(s_suppkey as varchar) as id, s_name as label, s_nationkey as nation from supplier")
def shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 to SRC5: suppliers written as hashed JSON shards and let in again, all of them or none."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 100).alias("shard"), F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("nation")).alias("r"))
    bodies = rows.groupBy("shard").agg(F.to_json(F.struct(F.lit("v1").alias("schemaVersion"), F.sort_array(F.collect_list("r")).alias("records"))).alias("value"))
    bodies.repartition("shard").select("value").write.option("maxRecordsPerFile", 1).text(folder)
    found = pinned.files(spark, folder, "part-*").where("bytes > 0")
    manifest = found.select(F.substring_index("path", "/", -1).alias("path"), "sha", "bytes", F.json_array_length(F.get_json_object(F.col("body").cast("string"), "$.records")).alias("records"))
    manifest = manifest.crossJoin(F.broadcast(manifest.agg(F.sum("records").alias("record_count"))))
    return pinned.load_shards(spark, folder, manifest, "id string, label string, nation int", pattern=r"\Apart-[A-Za-z0-9-]+\.txt\z", glob="part-*", most=100_000)


@query("select cast(c_custkey as varchar) as id, c_name as label, c_nationkey as nation from customer")
def receipt_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3, SRC5: customers written as shards of 500, a manifest for each 40 of them, an index and its receipt; let in again from the receipt down."""
    folder = scratch(spark)
    numbered = F.floor((F.col("c_custkey") - 1) / 500)
    rows = table(spark, sf_dir, "customer").select(numbered.alias("shard"), F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("nation")).alias("r"))

    def put(bodies: DataFrame) -> DataFrame:
        """Files named by what they are, and ``(part, link)``: what the next level says of each."""
        bodies.select("file", "value").repartition("file").write.mode("append").partitionBy("file").option("maxRecordsPerFile", 1).text(folder)
        return bodies.select("part", F.struct(F.col("file").alias("path"), F.sha2(F.concat("value", F.lit("\n")), 256).alias("sha256"), (F.octet_length("value") + 1).cast("long").alias("bytes"), "records").alias("link"))

    named = lambda kind, n: F.concat(F.lit(kind), F.col(n).cast("string"))
    shards = put(rows.groupBy("shard").agg(F.to_json(F.struct(F.lit("v1").alias("schemaVersion"), F.sort_array(F.collect_list("r")).alias("records"))).alias("value"), F.count("*").alias("records")).select(named("shard-", "shard").alias("file"), "value", "records", F.floor(F.col("shard") / 40).alias("part")))
    listed = shards.groupBy("part").agg(F.to_json(F.struct(F.sort_array(F.collect_list("link")).alias("shards"), F.sum("link.records").alias("recordCount"))).alias("value"))
    manifests = put(listed.select(named("manifest-", "part").alias("file"), "value", F.lit(None).cast("long").alias("records"), F.lit(0).alias("part")))
    index = put(manifests.groupBy("part").agg(F.to_json(F.struct(F.sort_array(F.collect_list("link")).alias("manifests"))).alias("value")).select(F.lit("index").alias("file"), "value", F.lit(None).cast("long").alias("records"), "part"))
    put(index.select(F.lit("receipt").alias("file"), F.to_json(F.struct(F.lit("accepted").alias("status"), F.lit("r").alias("reviewer"), F.lit("e").alias("evidenceId"), F.col("link.sha256").alias("indexSha256"))).alias("value"), F.lit(None).cast("long").alias("records"), "part"))
    return pinned.load_collection(spark, folder, "receipt", "id string, label string, nation int", index="index", glob="*.txt", name="regexp_extract(path, 'file=([^/]+)/', 1)")


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def strict_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: nations written as CSV and read by the strict source."""
    folder = scratch(spark)
    table(spark, sf_dir, "nation").write.option("header", True).csv(folder)
    strict_csv.register(spark)
    return spark.read.format("strict_csv").options(path=folder, columns="n_nationkey,n_name,n_regionkey").load()


@query("""
select 'accepted' as rule_id, count(*) filter (n_nationkey % 5 = 1) as n from nation having n > 0
union all select 'digest_bundleSha256', count(*) filter (n_nationkey % 5 = 2) from nation
union all select 'fields', count(*) filter (n_nationkey % 5 = 3) from nation
""")
def receipt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of which some are drafts, some have a malformed digest and some a field too many."""
    k = F.col("n_nationkey")
    base = [F.when(k % 5 == 1, "draft").otherwise("accepted").alias("status"), F.col("n_name").alias("reviewer"), F.lit("2026-01-02").alias("reviewedOn"), F.lit("e").alias("evidenceId"), F.lit("s").alias("scope"), F.array().cast("array<string>").alias("limitations")]
    base += [F.when(k % 5 == 2, "xyz").otherwise(F.sha2("n_name", 256)).alias("bundleSha256"), F.array(F.lit("c")).alias("checks")]
    rows = table(spark, sf_dir, "nation").select(k.cast("string").alias("id"), F.when(k % 5 == 3, F.to_json(F.struct(*base, F.lit(1).alias("note")))).otherwise(F.to_json(F.struct(*base))).alias("receipt"))
    return broken(rows, pinned.receipt_rules("foundation"))


@query("""
select sha256(string_agg(p, chr(10) order by p)) as sha from (select cast(n_nationkey as varchar) || ':' || sha256(n_name) as p from nation)
""")
def release_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6: one digest for a set of files."""
    return sinks.identity(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.sha2("n_name", 256).alias("sha")))


@query("""
select 'pin' as check, cast(doc_id as varchar) as detail from documents where doc_id % 40 in (1, 2)
union all select 'hold', cast(n_nationkey as varchar) from nation where n_nationkey < 2
union all select 'flag', r_name from region where r_regionkey % 2 = 1
""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, J19: drifted and missing pins, retained holds, and flags that should be off."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha"), "doc_id")
    files = d.where("doc_id % 40 <> 1").select("path", F.when(F.col("doc_id") % 40 == 2, F.sha2("path", 256)).otherwise(F.col("sha")).alias("sha"))
    held = table(spark, sf_dir, "nation").where("n_nationkey < 2").select(F.col("n_nationkey").cast("string").alias("path"))
    flags = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") % 2 == 1).alias("enabled"))
    return journal.ready(d.select("path", "sha"), files, held, flags)


@query("""
select page_id, case when page_id % 6 = 1 then 'body is not the receipt''s' when page_id % 6 = 2 then 'chronology' when page_id % 6 = 3 then 'unexpected response' when page_id % 6 = 4 then 'unexpected type' when page_id % 6 = 5 then 'content length' when page_id % 12 = 6 then 'access challenge'
  when page_id % 60 = 12 then 'response address' when page_id % 60 = 24 then 'incomplete headers' when page_id % 60 = 36 then 'disposition' when page_id % 60 = 48 then 'unexpected response' else '' end as problems from pages
""")
def capture_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.12: pages as captured bodies, most with something wrong in their receipt."""
    k = F.col("page_id")
    body = F.when(k % 12 == 6, F.concat("html", F.lit(" Please solve this CAPTCHA"))).otherwise(F.col("html"))
    n = F.octet_length(body)
    receipt = F.to_json(F.struct(
        F.col("url").alias("url"), F.when(k % 60 == 48, F.parse_json(F.lit('"200"'))).when(k % 6 == 3, F.parse_json(F.lit("404"))).otherwise(F.parse_json(F.lit("200"))).alias("status"), F.lit(True).alias("complete"), n.alias("bodyBytes"), F.when(k % 6 == 1, F.sha2("url", 256)).otherwise(F.sha2(body, 256)).alias("bodySha256"),
        F.struct(F.when(k % 6 == 4, "text/plain").otherwise("Text/HTML; charset=utf-8").alias("content-type"), F.when(k % 6 == 5, "12x").otherwise(F.concat(F.lit("00"), n.cast("string"))).alias("content-length")).alias("headers"),
        F.when(k % 60 == 36, "held_no_retry").otherwise("received_for_semantic_review").alias("disposition"), F.when(k % 60 == 12, "https://other.example/").when(k % 2 == 0, F.col("url")).alias("responseURL"), F.when(k % 60 == 24, False).when(k % 5 == 0, True).alias("headersComplete"),
        F.lit("2026-01-01T00:00:00Z").alias("attemptedAt"), F.lit("2026-01-01T00:00:01Z").alias("headersReceivedAt"), F.when(k % 6 == 2, "2026-01-01T00:00:59Z").otherwise("2026-01-01T00:00:02+00:00").alias("completedAt"),
    ))
    captures = table(spark, sf_dir, "pages").select("page_id", body.cast("binary").alias("body"), F.col("url").alias("wanted_url"), F.lit("text/html").alias("wanted_type"), receipt.alias("receipt"))
    return journal.capture_problems(captures).select("page_id", F.array_join("problems", ",").alias("problems"))


def attempts(events: DataFrame) -> DataFrame:
    """Events as outcome files of attempts; users are snapshots."""
    status = F.when(F.col("event_type") == "error", "held_no_retry").otherwise("candidate_prepared")
    body = F.when(F.col("event_id") % 10 == 3, '{"status":1,"status":2}').otherwise(F.to_json(F.struct(status.alias("status"), F.when(F.col("event_id") % 10 != 4, F.col("event_id").cast("double")).alias("completedAtEpoch"), F.lit("c").alias("candidateSha256"))))
    return events.select(F.col("user_id").cast("string").alias("snapshot"), F.concat(F.lit("attempts/"), F.col("event_id").cast("string"), F.lit("/outcome.json")).alias("path"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("bytes"), F.lit("x").alias("sha"), body.alias("body"))


@query("""
with e as (select event_id, event_type, event_id % 10 as k from events)
select 'malformed_journal_record' as code, count(*) as n from e where k = 3
union all select 'unknown_completion_time', count(*) from e where k = 4
union all select 'failed_or_unknown_outcome_preserved', count(*) from e where k <> 3 and event_type = 'error'
union all select 'candidate_outcome_binding_unverified', count(*) from e where k <> 3 and event_type <> 'error'
union all select 'missing_journal_record', 8 * count(*) + (select count(distinct user_id) from events) from e
""")
def journal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: findings of retained snapshots, nothing dropped."""
    files = attempts(table(spark, sf_dir, "events"))
    return journal.findings(files, parts=parts(files)).groupBy("code").agg(F.count("*").alias("n"))


@query("""
with e as (select event_id, event_type, event_id % 10 as k from events)
select 'malformed_journal_record' as code, count(*) as n from e where k = 3
union all select 'unknown_completion_time', count(*) from e where k = 4
union all select 'failed_or_unknown_outcome_preserved', count(*) from e where k <> 3 and event_type = 'error'
union all select 'candidate_outcome_binding_unverified', count(*) from e where k <> 3 and event_type <> 'error'
union all select 'missing_journal_record', 8 * count(*) + (select count(distinct user_id) from events) from e
""")
def journal_findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 over all events."""
    files = attempts(table(spark, sf_dir, "events"))
    return journal.findings(files, parts=parts(files)).groupBy("code").agg(F.count("*").alias("n"))


@query("""
with s as (select c_nationkey as k, sum(cast(c_acctbal as decimal(18, 2))) as v from customer group by all)
select k, k % 3 <> 1 as comparable, case when k % 3 <> 1 then '250.500000' end as difference from s
""")
def comparable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise comparison of stages; unlike units are refused."""
    return compared(spark, sf_dir, "original_estimate", True)


@query("""
with s as (select distinct c_nationkey as k from customer)
select k, strict, not strict and k % 3 <> 1 as comparable, case when not strict and k % 3 <> 1 then '250.500000' end as difference from s, (values (true), (false)) t(strict)
""")
def comparable_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that form no pair are compared only where the stage is not asked for."""
    each = [compared(spark, sf_dir, "capital_plan", strict).withColumn("strict", F.lit(strict)) for strict in (True, False)]
    return each[0].union(each[1])


def compared(spark: SparkSession, sf_dir: str, first: str, strict: bool) -> DataFrame:
    """Balances of nations as facts of two stages, compared."""
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("v"))
    k = F.col("k")

    def fact(stage, value, unit):
        lit = {n: F.lit("x") for n in ("metric", "accountingBasis", "reportingPerimeter", "entity", "jurisdiction")} | {"currency": F.lit("CAD"), "measureType": F.lit("flow")}
        period = F.struct(F.lit("2024-04-01").alias("start"), F.lit("2025-03-31").alias("end"), F.lit("2024-25").alias("label"), F.lit(None).cast("string").alias("asOf"))
        return F.struct(*[c.alias(n) for n, c in lit.items()], unit.alias("unit"), F.lit(1000).cast("long").alias("multiplier"), F.lit(stage).alias("stage"), value.cast("string").alias("rawValue"), period.alias("period"))

    unit = F.when(k % 3 == 1, "CAD_millions").otherwise("CAD_thousands")
    pairs = s.select("k", fact(first, F.col("v"), F.lit("CAD_thousands")).alias("a"), fact("amended_estimate", F.col("v") + F.lit("250.50").cast("decimal(18,2)"), unit).alias("b"))
    return identity.compare(pairs, strict).select("k", "comparable", "difference")


@query("select n_nationkey as a, n_regionkey as b, coalesce((n_nationkey * 2) % 7 = (n_regionkey * 3) % 7 and n_nationkey % 5 <> 4, false) as equal from nation")
def equal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facts said to be one measure are equal or not; an unknown one never is."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), (F.col("n_regionkey") + 1000).alias("b"))
    facts = n.select(F.col("a").alias("id"), F.when(F.col("a") % 5 != 4, F.col("a") * 2 % 7).alias("value")).union(n.select(F.col("b").alias("id"), ((F.col("b") - 1000) * 3 % 7).alias("value")).distinct())
    return joins.equal_pairs(facts, n).select("a", (F.col("b") - 1000).alias("b"), "equal")


@query("select o_orderkey from orders join customer on c_custkey = o_custkey where c_acctbal > 0 and o_orderkey % 3 <> 0")
def pinned_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children whose parent, by digest and record, was admitted."""
    return admitted_children(spark, sf_dir, "c_acctbal > 0")


@query("select o_orderkey from orders join customer on c_custkey = o_custkey where c_mktsegment <> 'MACHINERY' and o_orderkey % 3 <> 0")
def pinned_children_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 with parents admitted by their segment."""
    return admitted_children(spark, sf_dir, "c_mktsegment <> 'MACHINERY'")


def admitted_children(spark: SparkSession, sf_dir: str, admitted: str) -> DataFrame:
    """Orders of the customers that a condition admits; those without a digest have no parent."""
    parents = table(spark, sf_dir, "customer").where(admitted).select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha"), F.col("c_custkey").alias("record_id"))
    children = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("record"), F.when(F.col("o_orderkey") % 3 != 0, F.sha2(F.col("o_custkey").cast("string"), 256)).alias("parent_sha"))
    return joins.pinned(children, parents, record="record").select("o_orderkey")


@query("select p_partkey, p_partkey % 4 = 0 as same from part")
def ordered_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays are equal only in order, and never through a null."""
    k = F.col("p_partkey")
    a = F.array(F.lit("M1"), F.lit("M2"))
    other = F.when(k % 4 == 0, a).when(k % 4 == 1, F.array(F.lit("M2"), F.lit("M1"))).when(k % 4 == 2, F.array(F.lit("M1"))).otherwise(F.array(F.lit("M1"), F.lit(None).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", joins.same_array(F.when(k % 4 == 3, other).otherwise(a), other).alias("same"))


@query("""
select page_id, case when url like 'https://%' then split_part(url, '#', 1) || ',' else '' end || 'https://z.example/own' as urls from pages
""")
def bundle_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Https addresses anywhere in a bundle, sources skipped, fragments dropped."""
    body = F.to_json(F.struct(F.col("url"), F.struct(F.col("url").alias("sourceURL"), F.lit("https://z.example/own#x").alias("url")).alias("nested"), F.array(F.struct(F.lit("https://skipped.example").alias("url"))).alias("sources")), {"ignoreNullFields": "true"})
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), body.alias("body"))
    return catalog.https_urls(rows).select(F.col("id").alias("page_id"), F.array_join("urls", ",").alias("urls"))


@query("""
select 'guide-' || lpad(cast(p_partkey as varchar), cast(greatest(3, length(cast(p_partkey as varchar))) as int), '0') as id, p_brand as entity, 'audited_actual' as stage, p_type as metric, case when p_partkey % 5 <> 0 then cast(p_size as varchar) end as raw_value from part
""")
def seed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional values as named facts; values that are no number stay unknown."""
    return seeded(table(spark, sf_dir, "part"))


@query("""
select 'guide-' || lpad(cast(p_partkey as varchar), cast(greatest(3, length(cast(p_partkey as varchar))) as int), '0') as id, p_brand as entity, 'audited_actual' as stage, p_type as metric, case when p_partkey % 5 <> 0 then cast(p_size as varchar) end as raw_value from part
""")
def seed_facts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 over all parts."""
    return seeded(table(spark, sf_dir, "part"))


def seeded(parts: DataFrame) -> DataFrame:
    """Parts as facts of twelve positional values."""
    k = F.col("p_partkey")
    values = F.array(F.concat_ws("|", "p_brand", F.lit("audited_actual"), "p_type"), F.col("p_name"), F.when(k % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")), *[F.lit(f"v{i}") for i in range(9)])
    return catalog.seed_facts(parts.select(k.alias("row"), values.alias("values"))).select("id", "entity", "stage", "metric", "raw_value")


@query("""
select 'date_awarded' as rule_id, count(*) filter (o_orderkey % 31 = 0 and o_orderstatus <> 'P') as n from orders
union all select 'categories', count(*) filter (o_orderkey % 37 = 0) from orders
union all select 'amount', count(*) filter (o_orderkey % 41 = 0) from orders
union all select 'id_unique', 1
""")
def award_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suite of awards over orders with planted faults."""
    k = F.col("source_row_id").cast("long")
    rows = awards(spark, sf_dir).withColumn("closed", F.lit(None).cast("string")).withColumn("started", F.lit(None).cast("string"))
    rows = rows.withColumn("awarded", F.when(F.col("awarded").isNotNull(), F.date_format("awarded", "yyyy-MM-dd"))).withColumn("awarded", F.when((k % 31 == 0) & F.col("awarded").isNotNull(), F.concat("awarded", F.lit("T00"))).otherwise(F.col("awarded")))
    rows = rows.withColumn("amount", F.when(k % 41 == 0, "1,000").otherwise("10.5")).withColumn("categories", F.when(k % 37 == 0, F.create_map(F.lit("goods"), F.lit("Y"))).otherwise(F.col("categories")))
    return broken(rows.withColumn("id", F.when(k == 1, F.lpad(F.lit("0"), 9, "0")).otherwise(F.col("id"))), collections.tenders())


@query("""
with t as (select lang, cast(sum(quality) as int) as completed, cast(count(*) - sum(quality) as int) as not_completed from documents join labels using (doc_id) group by lang)
select 'sum' as rule_id, count(*) as n from t where lang = 'fr' union all select 'percent', count(*) from t where lang = 'es'
""")
def audit_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that add up and percentages that fit, wrong for two languages."""
    t = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("lang").alias("id")).agg(F.sum("quality").alias("completed"), (F.count("*") - F.sum("quality")).alias("not_completed"))
    whole = F.col("completed") + F.col("not_completed")
    t = t.withColumn("total", whole + F.when(F.col("id") == "fr", 1).otherwise(0)).withColumn("percent", F.round(F.col("completed") * 100 / F.col("total")).cast("long") + F.when(F.col("id") == "es", 2).otherwise(0)).withColumn("current_status_verified", F.lit(False))
    return broken(t, collections.audits())


@query("""
select 'status' as rule_id, count(*) as n from (select c_acctbal from customer where c_custkey % 23 = 0 and cast(c_acctbal as decimal(18, 2)) <> 0)
union all select 'year', count(*) from customer where c_custkey % 29 = 0
""")
def category_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts whose status says another sign, and years that do not follow."""
    k = F.col("c_custkey")
    v = F.col("c_acctbal").cast("decimal(18,2)")
    status = F.when((k % 23 == 0) | (v == 0), "explicit_zero").when(v < 0, "negative_reported_value").otherwise("positive_reported_value")
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), F.when(k % 29 == 0, "2023-2025").otherwise("2023-2024").alias("year"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("subcategory"), v.cast("string").alias("reported_amount"), status.alias("amount_status"))
    return broken(rows, collections.physician())


@query("""
select 'column_total' as rule_id, count(*) as n from (select distinct c_nationkey from customer where c_nationkey % 4 = 2)
""")
def statement_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a column come to its total; for some nations one is missing."""
    v = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("v"))
    nation = F.col("c_nationkey").cast("string")
    t = v.groupBy("c_nationkey").agg(F.sum("v").alias("v"), F.min("c_mktsegment").alias("first"))
    parts = v.join(t.select("c_nationkey", "first"), "c_nationkey").select(F.concat(nation, "c_mktsegment").alias("id"), nation.alias("table"), F.lit("2025").alias("source_column"), F.lit("component").alias("role"), F.when(~((F.col("c_nationkey") % 4 == 2) & (F.col("c_mktsegment") == F.col("first"))), F.col("v").cast("string")).alias("value"))
    whole = t.select(F.concat(nation, F.lit("total")).alias("id"), nation.alias("table"), F.lit("2025").alias("source_column"), F.lit("total").alias("role"), F.col("v").cast("string").alias("value"))
    return broken(parts.union(whole), collections.statements())


@query("select c_custkey, c_custkey % 3 <> 0 and c_nationkey % 2 = 0 and c_mktsegment <> 'MACHINERY' as public from customer")
def public_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    k = F.col("c_custkey")
    pub = F.struct((k % 3 != 0).alias("allowed"), F.lit(False).alias("consequentialAllegation"), F.lit("neutral_source_comparison").alias("reviewType"), F.col("c_name").alias("reviewId"), F.when(F.col("c_nationkey") % 2 == 0, "2026-01-01").alias("reviewedOn"))
    facts = F.when(F.col("c_mktsegment") != "MACHINERY", F.array(F.lit("f"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", pub.alias("publication"), F.lit("documented_comparison").alias("status"), F.lit("calculated_source_comparison").alias("classification"), facts.alias("fact_ids"), F.array(F.lit("e")).alias("evidence_ids"))
    return rows.select("c_custkey", catalog.public_case(rows).alias("public"))


@query("""
select n_nationkey, case n_nationkey % 4 when 0 then 'record' when 1 then 'find' when 2 then 'not-found' else 'investigation' end as page,
  case n_nationkey % 4 when 0 then n_name || ' x' when 3 then n_name end as id, case n_nationkey % 4 when 3 then 'detail' end as depth from nation
""")
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading of page addresses."""
    k = F.col("n_nationkey") % 4
    address = F.when(k == 0, F.concat(F.lit("#/record/"), "n_name", F.lit("%20x"))).when(k == 1, "#/find?q=1").when(k == 2, F.concat(F.lit("#/nowhere/"), "n_name")).otherwise(F.concat(F.lit("#/investigation/"), "n_name", F.lit("?depth=detail")))
    return table(spark, sf_dir, "nation").select("n_nationkey", urls.route(address).alias("r")).select("n_nationkey", "r.page", "r.id", "r.depth")


@query("""
select event_id, case when event_id % 3 = 0 then strftime(ts - interval 2 hours, '%Y-%m-%d %H:%M:%S') when event_id % 3 = 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') end as at,
  case when event_id % 3 <> 2 then strftime(ts, '%Y-%m-%d') end as day from events
""")
def instants_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants need an offset, dates need all their digits."""
    k = F.col("event_id") % 3
    wall = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(wall, F.lit("+02:00"))).when(k == 1, F.concat(wall, F.lit("Z"))).otherwise(wall)
    day = F.when(k == 2, F.date_format("ts", "yyyy-M-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(dates.instant(raw), "yyyy-MM-dd HH:mm:ss").alias("at"), dates.strict_date(day).cast("string").alias("day"))


@query("""
select c_custkey, case when c_custkey % 5 = 0 then 'Not established' else case when round(cast(c_acctbal as decimal(18, 2)), 0) < 0 then '-$' else '$' end || format('{:,}', abs(cast(round(cast(c_acctbal as decimal(18, 2)), 0) as bigint))) end as shown, case when c_mktsegment = 'BUILDING' then 'Buildings' else replace(c_mktsegment, '_', ' ') end as label
from customer
""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and labels for display; unknown amounts are not established."""
    v = F.when(F.col("c_custkey") % 5 != 0, F.round(F.col("c_acctbal").cast("decimal(18,2)"), 0))
    return table(spark, sf_dir, "customer").select("c_custkey", exact.display_money(v).alias("shown"), text.pretty(F.col("c_mktsegment"), {"BUILDING": "Buildings"}).alias("label"))


@query("select c_mktsegment, cast(sum(cast(c_acctbal as decimal(18, 2))) as varchar) as total, count(*) as n from customer group by c_mktsegment")
def declared_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums are denied unless their scope was declared."""
    rows = table(spark, sf_dir, "customer").withColumn("v", F.col("c_acctbal").cast("decimal(18,2)"))
    return reconcile.Measure("v", ["c_mktsegment"]).total(rows, "c_mktsegment").withColumn("total", F.col("total").cast("string"))


@query("select o_orderkey as id, c_name as customer, n_name as nation from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey")
def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact with its evidence and its source."""
    return pages(spark, sf_dir, table(spark, sf_dir, "orders"))


@query("select o_orderkey as id, c_name as customer, n_name as nation from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey")
def record_pages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 over all orders."""
    return pages(spark, sf_dir, table(spark, sf_dir, "orders"))


def pages(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Orders as facts, with their customers as evidence and nations as sources."""
    facts = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("evidence_id"))
    evidence = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_nationkey").alias("source_id"))
    sources = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    return catalog.record_page(facts, evidence, sources).select("id", F.col("evidence.c_name").alias("customer"), F.col("source.n_name").alias("nation"))
