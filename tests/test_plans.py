"""The shape of plans: what reaches the scan, what is broadcast, where Python runs."""

import re

import pytest
from pyspark.sql import functions as F

from tallyspark import plans
from tallyspark.operators import gates, joins, search

SF = "/root/testdata/sf0.001"
#: Queries with a step that Spark has no function for, and the one that joins a one-row total onto its manifest.
PYTHON = {"search_all_words", "awards_filtered", "awards_page", "directory_find", "canonical_digests", "rule_engine", "strict_csv_round_trip", "bundle_urls", "public_fields", "same_objects", "word_filters", "collection_coverage", "adapted_rules", "history_findings", "directory_differences"}
ONE_ROW = {"shard_round_trip", "cadence_floor"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_no_cross_joins_and_no_python_without_need(spark, name):
    text = plan(plans.QUERIES[name](spark, SF))
    if name not in ONE_ROW:
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    if name not in PYTHON:
        assert not re.search("Python|Pandas|Arrow|MapInPandas", text)


def test_filters_and_columns_reach_the_scan(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(rows.where(search.within("o_orderdate", "1996-01-01", "1997-01-01") & search.equals("o_orderstatus", "F")).select("o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in text and re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp\w*>", text)
    text = plan(plans.QUERIES["label_enrichment"](spark, SF))
    assert "BroadcastHashJoin" in text and "l_comment" not in text and "l_quantity" not in text


def test_a_side_is_broadcast_only_within_its_bound(spark):
    labels = spark.range(1000).select(F.col("id").alias("k"))
    assert "broadcast" in joins.small(labels)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.small(labels, bound=10)._jdf.queryExecution().logical().toString().lower()


def test_row_rules_share_one_scan(spark):
    rules = [gates.row(f"r{i}", F.col("l_quantity") > i) for i in range(20)] + [gates.agg("n", F.count("*") > 0), gates.agg("m", F.max("l_tax") < 1)]
    text = plan(gates.violations(spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("id", F.col("l_orderkey")), rules))
    assert len(re.findall("FileScan|Scan parquet", text)) == 2


def test_spread_parts_grow_in_number(spark, monkeypatch):
    """A table with more rows has more parts, and rows of a key stay together."""
    from pyspark.sql import functions as F

    from tallyspark.plans import registry

    monkeypatch.setattr(registry, "PART_ROWS", 10)
    parts = registry.spread(spark.range(200).select((F.col("id") % 50).alias("k")), "k")
    assert parts.rdd.getNumPartitions() == 20
    assert parts.select("k", F.spark_partition_id().alias("p")).distinct().count() == 50


def test_pins_are_dealt_out_by_path_alone(spark):
    """Bodies of manifests are not shuffled, and files and pins once each."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(plans.QUERIES["readiness_pins"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    assert keys and all(re.fullmatch(r"path#\d+", k) for k in keys)
    assert len(keys) == 9  # four times the lines, three times the orders, files, pins
