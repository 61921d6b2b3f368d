"""Decontamination judges each row by its own text."""

import corpus_pipeline

from test_operators import SF


def test_null_and_repeated_ids(spark):
    start = spark.read.parquet(f"{SF}/documents.parquet")
    leak = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    rows = [(None, leak, "en", "s", 1), (7, leak, "en", "s", 1), (7, "clean words that are in no benchmark", "en", "t", 1), (None, "other clean words", "en", "s", 1), (8, None, "en", "s", None)]
    kept = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, start.schema), SF)
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((i, t)) for i, t, *_ in rows if t != leak)
    assert kept.schema.names == start.schema.names
