"""Benchmark decontamination: size-partitioned MinHash containment, verified exactly. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few

WIDTH = 5
THRESHOLD = 0.8


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words_column: str, width: int) -> Column:
    """Distinct shingles of ``width`` words; none if there are fewer words."""
    w = F.col(words_column)
    at = F.sequence(F.lit(1), F.size(w) - width + 1)
    return F.when(F.size(w) >= width, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, width), " ")))).otherwise(F.array().cast("array<string>"))


def hashes(hashed_words: str, width: int) -> Column:
    """Hash of every shingle, repeats included, from the hashes of its words."""
    h = F.col(hashed_words)
    at = F.sequence(F.lit(0), F.size(h) - width)
    parts = lambda i: [h[i + k] for k in range(width)]
    return F.when(F.size(h) >= width, F.transform(at, lambda i: F.xxhash64(*parts(i)))).otherwise(F.array().cast("array<bigint>"))


def sketch(benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``(item, item_id, width, q, part, hash)``: the bottom-k MinHash sketch of each item's shingles.

    ``part`` is the size class (powers of two of the shingle count q) and k is just over the share of
    shingles that a match may lack: a text that holds ``threshold`` of an item's q shingles lacks at
    most q - ceil(threshold * q) of them, so it holds one of the k = q - ceil(threshold * q) + 1
    smallest hashes. The search over sketches therefore misses nothing.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("item", F.array_join("w", " ")).withColumn("width", F.least(F.size("w"), F.lit(width)))
    items = items.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    by_width = F.coalesce(*[F.when(F.col("width") == k, hashes("h", k)) for k in range(1, width + 1)])
    items = items.withColumn("all", F.array_sort(F.array_distinct(by_width))).withColumn("q", F.size("all"))
    lacking = F.col("q") - F.ceil(F.col("q") * F.lit(threshold) - 1e-9)
    return items.withColumn("part", F.floor(F.log2(F.col("q").cast("double"))).cast("int")).select(
        "item", "item_id", "width", "q", "part", F.explode(F.slice("all", F.lit(1), (lacking + 1).cast("int"))).alias("hash")
    )


def _at_most(top: Column):
    return lambda x: x <= top


def _named(width: int):
    return lambda x: F.struct(F.lit(width).alias("width"), x.alias("hash"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` for every item found in a document.

    An item is found where at least ``threshold`` of its distinct shingles of ``width`` words occur in
    the document; an item of fewer words is one shingle, all of its words. Words are lower-cased runs
    of letters and digits.

    Items are partitioned by size, and the largest hash in a partition's sketches bounds what a
    document must offer it; documents too small for a partition do not probe it. What a document
    offers is filtered by that bound before it is exploded and joined on the hash. Pairs that meet are
    verified on the shingles themselves (where they are few, their ids are broadcast so that other texts
    are not shuffled), so neither the sketch nor a hash collision changes the result.
    The few bounds (one for each size class and width) are all that reaches the driver.

    Null, empty and wordless texts contain nothing and are in nothing. Of rows that repeat a doc_id or
    an item_id the highest containment is given. Rows with a null doc_id or item_id are left out. An
    empty table on either side gives an empty result; other columns are not read.
    """
    items = cut(sketch(benchmark.where("item_id is not null"), width, threshold))
    bounds = items.groupBy("width", "part").agg(F.max("hash").alias("top"), F.min("q").alias("q")).collect()
    source = docs.select("doc_id", "text").where("doc_id is not null")
    if not bounds:
        return source.select("doc_id", F.col("doc_id").alias("item_id"), F.lit(0).alias("n_shared"), F.lit(0).alias("n_item"), F.lit(0.0).alias("containment")).where(F.lit(False))
    hashed = source.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    offers = []
    for k in sorted({b.width for b in bounds}):
        mine = sorted((b for b in bounds if b.width == k), key=lambda b: b.q)
        top = F.lit(None).cast("long")
        for b in mine:  # a document of n words has at most n - k + 1 shingles
            enough = F.size("h") - (k - 1) >= F.lit(b.q) * threshold - 1e-9
            top = F.when(enough, F.greatest(top, F.lit(b.top))).otherwise(top)
        offered = F.array_distinct(F.filter(hashes("h", k), _at_most(top)))
        offers.append(F.transform(offered, _named(k)))
    # One pass over the texts: words are cut and hashed once, whatever the number of widths.
    probe = hashed.select("doc_id", F.explode(F.concat(*offers)).alias("o")).select("doc_id", "o.width", "o.hash")
    sketches = few(items.select("width", "hash", "item").distinct())
    met = probe.join(sketches, ["width", "hash"]).select("doc_id", "item").distinct()
    whole = items.select("item", "width").distinct()
    met = met.join(whole, "item").groupBy("doc_id").agg(F.collect_set(F.struct("item", "width")).alias("items"))
    met = cut(met)
    texts = source.join(few(met.select("doc_id")), "doc_id", "left_semi").join(met, "doc_id").select("doc_id", words(F.col("text")).alias("w"), "items")
    every = F.array_distinct(F.concat(*[shingles("w", k) for k in sorted({b.width for b in bounds})]))
    pairs = texts.select("doc_id", every.alias("have"), F.explode("items").alias("i")).select("doc_id", "have", F.col("i.item").alias("item"), F.split(F.col("i.item"), " ").alias("iw"))
    want = F.coalesce(*[F.when(F.least(F.size("iw"), F.lit(width)) == k, shingles("iw", k)) for k in range(1, width + 1)])
    pairs = pairs.withColumn("want", want).select("doc_id", "item", F.size("want").alias("n_item"), F.size(F.array_intersect("have", "want")).alias("n_shared"))
    found = pairs.where(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9)
    ids = items.select("item", "item_id").distinct()
    best = found.join(ids, "item").groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_shared").alias("n_shared"), F.col("m.n_item").alias("n_item"), F.round("m.c", 6).alias("containment"))


ORACLE = """
with item as (
  select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w
  from benchmark where item_id is not null),
item_shingle as (
  select distinct item_id, least(len(w), 5) as width, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') as s
  from item, unnest(range(1, len(w) - least(len(w), 5) + 2)) as t(i) where len(w) > 0),
item_size as (select item_id, width, count(*) as n_item from item_shingle group by 1, 2),
doc as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w
  from documents where doc_id is not null),
doc_shingle as (
  select distinct doc_id, k as width, array_to_string(w[i : i + k - 1], ' ') as s
  from doc, (select distinct width as k from item_shingle) k, unnest(range(1, greatest(len(w) - k + 2, 1))) as t(i)),
shared as (
  select doc_id, item_id, count(*) as n_shared
  from doc_shingle join item_shingle using (width, s) group by 1, 2)
select doc_id, item_id, cast(n_shared as int) as n_shared, cast(n_item as int) as n_item, round(n_shared / n_item, 6) as containment
from shared join item_size using (item_id) where n_shared >= 0.8 * n_item - 1e-9
"""
