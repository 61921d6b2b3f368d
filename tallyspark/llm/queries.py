"""Thin queries over the test tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocation, decontam, divergence, embdedup, hilbert, langid, neighbours, quality, secrets, simhash, tokenfile, warc


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign(_table(spark, sf_dir), shards=8)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(_table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, in two replicas; the second has lost a bit in about one record of a hundred."""
    return warc.fixity(_table(spark, sf_dir, "pages"), F.col("page_id") % 101 == 7)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.mine(_table(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_resampling, op2_simhash_near_dedup, op3_language_id, op4_bpe_round_trip, op5_hilbert_shards,
        op6_token_files, op7_benchmark_decontamination, op8_embedding_near_dedup, op9_warc_fixity, op10_secret_scan,
        op11_source_divergence, op12_nearest_neighbours, op13_phrase_collocations,
    )
}

ORACLES: dict[str, str] = {
    "op7_benchmark_decontamination": decontam.ORACLE,
    "op8_embedding_near_dedup": """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
n as (select a, count(*) as n from link group by a),
c as (select a, min(b) as b from reach group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(b, vec_id)) as component_id, vec_id <= coalesce(b, vec_id) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
""",
    "op9_warc_fixity": """
select page_id, sha256(coalesce(html, '')) as payload_sha256,
  case when page_id % 101 = 7 then 'damaged' else 'intact' end as status
from pages
""",
    "op11_source_divergence": divergence.ORACLE,
    "op13_phrase_collocations": collocation.ORACLE,
}
