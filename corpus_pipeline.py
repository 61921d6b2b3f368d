"""A training-corpus pipeline of five stages over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, decontam, langid, secrets, simhash
from tallyspark.llm.common import cut, few

#: SQL cannot express the language model, the fingerprints, the tagger or the merges; tests use brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without letters or with no clear language go.

    Null and empty texts have no letters and go. Each row is judged by its own text, so rows that repeat a doc_id or
    have none are treated like any other, and equal texts alike. Without a document whose lang is known nothing can be
    learned and all go. An empty table stays empty. All columns of the rows that stay are as they were.
    """
    path = public_tokenizers.path("piece_bpe_32k.model")
    return langid.keep_known(docs, langid.train(docs.where(~langid.held_out()), path), path)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id; each row is judged by its own text.

    Rows get a key of their own, as in :func:`decontaminate`, so rows that repeat a doc_id or have none are compared like any others: unlike
    texts of one id all stay, and of copies one does. Of copies whose ids are equal too any one stays, and one with an id rather than one without.
    Null and wordless texts are copies of each other. An empty table stays empty.
    """
    rows, key = _with_keys(docs)
    found = cut(simhash.components(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id"))
    ids = rows.select(key, F.col("doc_id").alias("__id"))
    first = F.min(F.struct(F.col("__id").isNull().alias("nameless"), "__id", key))[key].alias(key)
    kept = cut(found.join(ids, key).groupBy("component_id").agg(first).select(key))
    dropped = found.select(key).join(kept, key, "left_anti")
    return rows.join(few(cut(dropped)), key, "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; each row is judged by its own text, whatever its doc_id.

    Rows get a key that is written with them, so that both sides of the join see the same one; it has a name that no column of theirs has.
    Null and empty texts hold nothing and stay; equal texts stay or go together; an empty table or benchmark takes nothing away.
    """
    rows, key = _with_keys(docs)
    leaks = decontam.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(few(cut(leaks.select(F.col("doc_id").alias(key)).distinct())), key, "left_anti").select(docs.columns)


def _with_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a key for each, and the key's name."""
    key = "__row"
    while key in docs.columns:
        key += "_"
    return cut(docs.withColumn(key, F.monotonically_increasing_id())), key


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in their texts are replaced by a mark.

    Null texts stay null; repeated rows are treated alike; an empty table stays empty. The tagger is trained on a bounded
    sample of the documents themselves.
    """
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the text they decode to.

    Every row gives a row, null texts count as empty, and an empty table gives an empty result.
    """
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("BPE encoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it; an empty table gives an empty result, nulls are as each stage says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
