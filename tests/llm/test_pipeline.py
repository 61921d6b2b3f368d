"""The pipeline's stages, each against brute force on its own input."""

import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_operators import SF, groups, slow_containment, slow_fingerprint, texts


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "BPE encoding"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    noise = spark.createDataFrame([(10_001, "1234 !!", "en", "s", 7), (10_002, None, None, None, None)], start.schema)
    docs = [start.union(noise)]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], SF).cache())
        if name != "BPE encoding":
            assert docs[-1].schema.names == start.schema.names
    read = [dict(texts(d)) for d in docs[:-1]]

    assert set(read[0]) - set(read[1]) == {10_001, 10_002}

    fp = {i: slow_fingerprint(t) for i, t in read[1].items()}
    ids = sorted(fp)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4]
    assert set(read[2]) == set(groups(ids, near).values())

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(read[2]) - set(read[3]) == {i for i, _ in slow_containment(read[2].items(), bench)}

    assert set(read[4]) == set(read[3])
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) for t in read[4].values())
    changed = [i for i in read[3] if read[3][i] != read[4][i]]
    assert all("[SECRET]" in read[4][i] for i in changed)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    assert {r.doc_id: r.n_tokens for r in docs[5].collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in read[4].items()}


def test_near_dedup_judges_rows(spark):
    """Unlike texts of one id stay, copies go whatever their ids, and of copies the smallest id stays."""
    start = spark.read.parquet(f"{SF}/documents.parquet")
    a, b, c = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten", "quite another thing altogether here and now"
    near = lambda rows: sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], start.schema), SF).collect())
    assert near([(1, a), (1, b), (2, a), (3, b)]) == sorted(map(str, [(1, a), (1, b)]))
    assert near([(1, a), (1, a), (2, a), (3, c), (3, b), (None, a), (None, c)]) == sorted(map(str, [(1, a), (3, c), (3, b)]))
    assert near([(None, a), (None, a), (None, b), (None, None), (7, ""), (8, " ")]) == sorted(map(str, [(None, a), (None, b), (7, "")]))
    assert corpus_pipeline.near_dedup(spark, start.limit(0), SF).count() == 0
    extra = corpus_pipeline.near_dedup(spark, start.limit(5).withColumn("__row", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("__id", F.lit(3)), SF)
    assert extra.columns == [*start.columns, "__row", "component_id", "__id"] and {r["__row"] for r in extra.collect()} == {1}


def test_whole_pipeline_of_nothing_and_of_nulls(spark, tmp_path):
    """Tables without rows, and rows with nulls in every column, run through all stages."""
    start = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    text = "The quick brown fox jumps over the lazy dog and runs home again before night falls."
    nulls = [(None, None, None, None, None), (1, None, "en", "s", None), (None, text, "en", None, 1), (2, "Another sentence about rivers and mountains that was never written down before today. password=abcdef12", None, "s", 3), (3, "", "en", "s", 0)]
    for name, docs, items, want in (("none", start.limit(0), bench.limit(0), 0), ("nulls", spark.createDataFrame(nulls, start.schema), spark.createDataFrame([(None, text), (1, None)], bench.schema), 2)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == want and all(r.n_tokens > 5 for r in got)
