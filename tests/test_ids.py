"""Positional ids beyond 999 keep all their digits."""

from pyspark.sql import functions as F

from tallyspark.operators import catalog, search


def test_ids_beyond_three_digits(spark):
    rows = spark.range(1, 1_201)
    seeds = rows.select(F.col("id").alias("row"), F.array(*[F.lit("x")] * 12).alias("values"))
    want = {f"guide-{n:03d}" for n in range(1, 1_201)}
    assert {r.id for r in catalog.seed_facts(seeds).select("id").collect()} == want
    assert {r.id for r in search.number_rows(rows.select(F.col("id").alias("n")), "guide-", "n").select("id").collect()} == want
