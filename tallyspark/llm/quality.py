"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, slices

#: Hash buckets of the n-gram models: enough to tell texts apart, few enough to be counted well in a small target.
BUCKETS = 1 << 13
#: Labelled rows (bounded) from which the target model is fitted.
LABELLED = 20_000
#: Pseudo count of a bucket in either model.
PSEUDO = 0.1
#: Intervals that keys are counted in at each round of the top-k search.
KEY_INTERVALS = 1 << 12
_ODD = 0x9E3779B97F4A7C15
_REPEAT = np.uint64(0x5DEECE66D1234567)
_CLASS = np.array([0 if b in b"\t\n\v\f\r " else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def ngram_buckets(data: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text) of all unigrams and bigrams of texts that lie end to end in ``data``.

    Tokens are runs of letters and digits (all bytes from 128 up count as letters) and runs of ASCII
    punctuation; case is kept, as capitals tell about quality. A token's hash is the polynomial in its
    bytes, taken from one running sum over the whole buffer. A bigram of a token with itself has the
    same hash whatever the token.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _CLASS[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[starts[starts < len(data)]] = True
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(data))
    word = kind[begin] != 0
    begin, end = begin[word], end[word]
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = _powers(1 << int(len(data)).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[end] - total[begin]) * down[begin]
    owner = np.searchsorted(starts, begin, side="right") - 1
    same = owner[1:] == owner[:-1]
    pair = np.where(h[1:] == h[:-1], _REPEAT, h[1:] * np.uint64(0xD6E8FEB86659FD93) + h[:-1])[same]
    every = np.concatenate([h, pair])
    every = (every ^ (every >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (every >> np.uint64(64 - int(math.log2(buckets)))).astype(np.int64), np.concatenate([owner, owner[1:][same]])


def _texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of the text column of a batch, nulls as empty texts."""
    column = part.column("text").cast(pa.large_binary()).fill_null(b"")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0]


def labelled_sample(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """``(doc_id, quality, good)`` of at most ``bound`` labelled documents, the first in a hashed order.

    Good means quality 1 and not toxic; of rows that repeat a doc_id the worst counts. Rows with a null
    doc_id or quality are left out, a null in toxic counts as not toxic.
    """
    rows = labels.where("doc_id is not null and quality is not null")
    fine = (F.col("quality") == 1).cast("int")
    rows = rows.select("doc_id", fine.alias("quality"), F.when(F.coalesce("toxic", F.lit(0)) == 0, fine).otherwise(0).alias("good"))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("good").alias("good"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(bound)


def ngram_counts(docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, raw, target)``: n-grams of all texts, and of the good ones in the sample.

    A task sends at most one row for each bucket. The sample is bounded and so may be broadcast.
    """

    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, budget=1_000_000):
                data, starts = _texts(part)
                at, owner = ngram_buckets(data, starts, buckets)
                good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)
                raw += np.bincount(at, minlength=buckets)
                target += np.bincount(at[good[owner]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    good = F.broadcast(sample.where("good = 1").select(F.col("doc_id").alias("__id")).distinct())
    marked = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("__id"), "left")
    marked = marked.select("text", F.col("__id").isNotNull().alias("good"))
    counts = map_batches(marked, run, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: DataFrame, buckets: int = BUCKETS, pseudo: float = PSEUDO) -> np.ndarray:
    """Log of target over raw probability for each bucket; the counts have at most ``buckets`` rows."""
    rows = counts.toPandas()
    raw, target = np.full(buckets, pseudo), np.full(buckets, pseudo)
    raw[rows["bucket"]] += rows["raw"]
    target[rows["bucket"]] += rows["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``(doc_id, log_weight)``: the log of target over raw probability of a text, the sum over its n-grams.

    Texts without n-grams have weight zero.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=1_000_000):
                data, starts = _texts(part)
                at, owner = ngram_buckets(data, starts, len(ratio))
                weight = np.bincount(owner, ratio[at], minlength=len(starts)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight)], names=["doc_id", "log_weight"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, log_weight double")


def gumbel(seed: int, *by: str) -> Column:
    """Standard Gumbel noise that depends on the named columns and the seed alone."""
    u = (F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _cutoff(rows: DataFrame, key: str, need: int, intervals: int) -> tuple[float | int, int, int]:
    """(value, rows needed of those that have it, rows that have it) of the ``need``-th largest ``key``, a double or a long.

    Rows are counted in equal intervals, again and again within the one that holds the place. What a
    round sends to the driver is one row an interval, however many rows are equal.
    """
    whole = rows.schema[key].dataType.typeName() == "long"
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while True:
        inside = rows.where((F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high)))
        if whole:
            at = F.expr(f"({key} - {low}L) div {(high - low) // intervals + 1}L")
        elif (width := (high - low) / intervals) > 0 and low + width > low and high - width < high:
            at = F.least(F.floor((F.col(key) - low) / width), F.lit(intervals - 1))
        else:  # a few neighbouring doubles
            at = F.col(key)
        found = inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("at")).collect()
        for one in found:
            if one["n"] >= need:
                break
            need -= one["n"]
        low, high = one["low"], one["high"]
        if low == high:
            return low, need, one["n"]


def top_k(rows: DataFrame, k: int, *keys: str, intervals: int = KEY_INTERVALS) -> DataFrame:
    """``rows`` with ``kept``: whether a row is among the ``k`` largest by the ``keys``, numbers without nulls.

    The cutoff is found for the first key; only if more rows than wanted are equal to it, for the next key
    among these. No task sorts all rows. Rows that are equal in all keys are kept or left together.
    """
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    if rows.count() <= k:
        return rows.withColumn("kept", F.lit(True))
    kept, same, need = F.lit(False), F.lit(True), k
    for key in keys:
        value, need, n = _cutoff(rows.where(same), key, need, intervals)
        kept = kept | (same & (F.col(key) > F.lit(value)))
        same = same & (F.col(key) == F.lit(value))
        if n == need:
            break
    return rows.withColumn("kept", kept | same)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, bound: int = LABELLED, seed: int = 7) -> DataFrame:
    """``(doc_id, log_weight, gumbel_key, kept)`` for every row of ``docs``.

    A document's log weight compares its hashed n-grams under a model of target text (the good ones of
    a bounded sample of ``labels``) and one of all texts. Gumbel noise is added and the rows with the largest
    keys are kept: a sample without replacement, in proportion to the weights, of ``share`` of all
    rows, by default the share of documents of quality 1 in the labelled sample.

    Null, empty and wordless texts have log weight zero. Rows with equal keys (those that repeat a doc_id and a
    text, say) are chosen from by a hash of the doc_id and then by their place in the table, so that the number
    of rows kept is exact. Without labels, all weights are near zero and all rows are kept; an empty table
    gives an empty result. Other columns are not read.
    """
    sample = cut(labelled_sample(labels, bound))
    good, fine, n = sample.agg(F.sum("good"), F.sum("quality"), F.count("*")).first()
    ratio = log_ratio(ngram_counts(docs, sample)) if good else np.zeros(BUCKETS)
    scored = score(docs, ratio).withColumn("gumbel_key", F.col("log_weight") + gumbel(seed, "doc_id"))
    scored = cut(scored.withColumn("tie", F.shiftrightunsigned(F.xxhash64("doc_id"), 2)).withColumn("place", F.monotonically_increasing_id()))
    share = (fine / n if good else 1.0) if share is None else share
    return top_k(scored, math.ceil(share * scored.count()), "gumbel_key", "tie", "place").drop("tie", "place")
