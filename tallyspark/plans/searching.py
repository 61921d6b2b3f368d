"""Searches, filters, pages and reshapes over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.urls import safe_url, without_fragment, without_query
from ..operators import catalog, search
from ..operators.joins import label
from .registry import query, table


@query("select doc_id, lang from documents where contains(lower(text), 'tion') and contains(lower(text), 'the')")
def search_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 in compatibility normal form."""
    return table(spark, sf_dir, "documents").where(text.all_words(" Tion  THE ", "text")).select("doc_id", "lang")


@query("select doc_id, lang from documents where contains(lower(text || ' ' || lang), 'menten') and contains(lower(text || ' ' || lang), 'es')")
def search_words_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words over joined fields, lower-cased only."""
    return table(spark, sf_dir, "documents").where(text.all_words("MENTEN es", "text", "lang", nfkc=False)).select("doc_id", "lang")


@query("select p_partkey from part where contains(lower(p_name), 'brand#1') or contains(lower(p_brand), 'brand#1') or contains(lower(p_type), 'brand#1')")
def search_any_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    return table(spark, sf_dir, "part").where(text.any_field(" Brand#1 ", "p_name", "p_brand", "p_type")).select("p_partkey")


@query("select p_partkey from part where contains(lower(p_name || ' ' || p_brand), 'ring brand#2')")
def search_across_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the phrase spans two fields."""
    return table(spark, sf_dir, "part").where(text.across_fields("Ring brand#2", "p_name", "p_brand")).select("p_partkey")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'bolt') and p_type = 'ECONOMY'")
def search_one_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 with an equality."""
    return search.filed(table(spark, sf_dir, "part"), "bolt", text.one_field("bolt", "p_name"), p_type="ECONOMY").select("p_partkey", "p_name")


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of awards: publisher is the customer's segment, dates of pending orders are unknown."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = label(orders.withColumnRenamed("o_custkey", "c_custkey"), customers, ["c_custkey"], ["c_mktsegment"])
    flag = lambda p: F.when(F.col("o_orderpriority").isin(*p), "Y").otherwise("N")
    return rows.select(
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("id"), F.col("o_orderkey").cast("string").alias("source_row_id"), F.col("o_orderpriority").alias("tender_id"), F.col("c_mktsegment").alias("publisher"),
        F.lit(None).cast("string").alias("supplier"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("awarded"),
        F.create_map(F.lit("goods"), flag(["1-URGENT", "2-HIGH"]), F.lit("service"), flag(["5-LOW"]), F.lit("construction"), F.lit("N")).alias("categories"),
    )


AWARDS = """
with awards as (
  select lpad(cast(o_orderkey as varchar), 9, '0') as id, o_orderpriority as tender_id, c_mktsegment as publisher,
    cast(o_orderkey as varchar) as source_row_id, case when o_orderstatus <> 'P' then cast(o_orderdate as date) end as awarded
  from orders left join customer on o_custkey = c_custkey)
"""


@query(AWARDS + """
select id, publisher, cast(awarded as varchar) as awarded from awards
where contains(lower(tender_id || ' ' || publisher || ' ' || source_row_id || ' '), 'high') and contains(lower(publisher), 'build')
  and awarded between date '1996-01-01' and date '1999-12-31' and tender_id in ('1-URGENT', '2-HIGH')
""")
def awards_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, publisher, dates and category; an unknown date fails a bound."""
    rows = search.observations(awards(spark, sf_dir), "high", entity="BUILD", low="1996-01-01", high="1999-12-31", category="goods")
    return rows.select("id", "publisher", F.col("awarded").cast("string").alias("awarded"))


@query(AWARDS + "select id, cast(awarded as varchar) as awarded from awards where contains(lower(tender_id || ' ' || publisher || ' ' || source_row_id || ' '), 'machinery') order by awards.awarded desc nulls last, id limit 25 offset 50")
def awards_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT1, LIM1: the third page of 25."""
    rows, *_ = search.page(search.observations(awards(spark, sf_dir), "machinery"), 3, search.PAGE_SIZES["tenders"])
    return rows.select("id", F.col("awarded").cast("string").alias("awarded"))


@query("select distinct cast(year(o_orderdate) as int) as year, o_orderstatus from orders")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT3."""
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return search.facets(rows, "year", "o_orderstatus", descending=True)


@query("""
select o_orderkey, cast(count(*) as int) as n_children, cast(max(l_linenumber) as int) as last_line
from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' and l_quantity >= 25 group by o_orderkey
""")
def nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders keep the lines that match, orders without any go."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity")).alias("lines"))
    kept = search.children(table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey"), "lines", lambda x: (x["l_returnflag"] == "R") & (x["l_quantity"] >= 25))
    return kept.select("o_orderkey", F.size("lines").alias("n_children"), F.array_max(F.transform("lines", lambda x: x["l_linenumber"])).alias("last_line"))


@query("""
select o_orderkey, cast(max(l_linenumber) as int) as only_line from orders join lineitem on l_orderkey = o_orderkey
where l_returnflag = 'A' group by o_orderkey having count(*) = 1
""")
def only_visible_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: an annotation is shown only if exactly one child is visible."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey")
    return orders.select("o_orderkey", search.only_child(orders, "lines").alias("only_line")).where("only_line is not null")


@query("select page_id, case when regexp_matches(url, '^https://') then url end as safe, regexp_replace(url, '\\?[^#]*', '') as shared, split_part(url, '#', 1) as bare from pages")
def url_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", safe_url(F.col("url")).alias("safe"), without_query(F.col("url")).alias("shared"), without_fragment(F.col("url")).alias("bare"))


TOPICS = {"coast": ["0", "2", "4", "6"], "inland": ["1", "2", "3"], "north": ["2", "4", "24"], "empty": ["999"]}


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as collections and regions as facts, in one directory."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("scope"), F.lit(1).alias("count"), F.lit("row").alias("count_unit"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("title"), F.lit("public").alias("entity"), F.lit("audited_actual").alias("stage"))
    return catalog.directory(nations, regions, TOPICS)


TOPIC_SQL = "(values ('coast', [0, 2, 4, 6]), ('inland', [1, 2, 3]), ('north', [2, 4, 24]), ('empty', [999])) as t(topic, ids)"


@query(f"select topic, count(*) as n from nation, {TOPIC_SQL} where list_contains(ids, n_nationkey) group by topic")
def directory_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET3, A26: topics overlap; those without entries are left out."""
    return catalog.topic_counts(entries(spark, sf_dir))


@query("""
select 'collection:' || n_nationkey as id, n_name as title from nation where n_nationkey in (2, 4, 24) and contains(lower(n_name || ' region ' || n_regionkey || ' 1 row'), 'region')
""")
def directory_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an unknown kind is no filter."""
    return catalog.find(entries(spark, sf_dir), "region", kind="anything", topic="north", topics=list(TOPICS)).select("id", "title")


@query("""
select r_regionkey, position, stage, case when stage = 'budget' then 'source_record' else 'not_established' end as evidence
from region, (values (0, 'budget'), (1, 'approval'), (2, 'contract'), (3, 'payment'), (4, 'delivery'), (5, 'outcome')) as s(position, stage)
""")
def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, M11."""
    return catalog.chain(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))).withColumnRenamed("id", "r_regionkey")


@query("select n_nationkey, 'guide-' || lpad(cast(row_number() over (order by n_name, n_nationkey) as varchar), 3, '0') as id from nation")
def positional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    return search.number_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "guide-", "n_name", "n_nationkey").select("n_nationkey", "id")


@query("""
select p_partkey, 'size' as measure, 'present' as presence, cast(p_size as varchar) as raw_value from part
union all select p_partkey, 'price', case when p_partkey % 10 = 0 then 'missing' else 'present' end, case when p_partkey % 10 <> 0 then cast(cast(p_retailprice as decimal(18, 2)) as varchar) end from part
""")
def measures_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of measures as rows."""
    known = F.col("p_partkey") % 10 != 0
    measure = lambda ok, v: F.struct(F.when(ok, "present").otherwise("missing").alias("presence"), F.when(ok, v).alias("rawValue"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("size"), measure(F.lit(True), F.col("p_size").cast("string")), F.lit("price"), measure(known, F.col("p_retailprice").cast("decimal(18,2)").cast("string"))).alias("m"))
    return catalog.measures(rows, "p_partkey", "m")


@query("""
select 'suppliers' as group_id, s_suppkey as id, s_name as name, null as segment from supplier
union all select 'customers', c_custkey, c_name, c_mktsegment from customer
""")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two shapes under the name of their group."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return catalog.tagged_union(suppliers=s, customers=c).select("group_id", "id", "name", "segment")
