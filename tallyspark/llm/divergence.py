"""Source divergence audit: how the terms of each source differ from those of the others of its language, by integer dictionaries."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, few, map_batches

#: Documents of a language in which a term must occur to be kept.
DOCUMENTS = 30
#: Terms returned for each group.
TOP = 50
SMOOTHING = 5
ONE = 1_000_000_000
#: Kept terms in a chunk of a dictionary, and so numbers in a vector.
CHUNK = 4096
#: Groups of a language whose vectors a task holds; each pair of blocks of groups is a task of its own.
BLOCK = 64
#: Distinct (group, term) rows that a task counts before it passes them on.
HELD = 400_000
_SLICE = 4_000_000

#: A to Z lower-cased, all other ASCII characters as blanks.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def terms_of(text: bytes):
    """The terms of a UTF-8 text, in lists for slices of it."""
    text, at = text.translate(_TERMS), 0
    while at < len(text):
        end = text.find(b" ", at + _SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(ONE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly.

    The division goes by three digits at a time, so that nothing passes 64 bits for totals below 9e15.
    """
    below = total + SMOOTHING * terms
    if below >= 1 << 53:
        return np.array([1 + ONE * (int(c) + SMOOTHING) // below for c in counts], np.int64)
    rest, share = counts + SMOOTHING, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        share, rest = share * 1000 + rest // below, rest % below
    return share + 1


def _count(batches):
    """Rows (lang, source, term, n, d): occurrences and documents, summed within a task; a row without a term for each group."""
    count: dict[tuple, Counter] = defaultdict(Counter)
    within: dict[tuple, Counter] = defaultdict(Counter)
    size = 0

    def rows():
        for (lang, source), found in count.items():
            terms, d = list(found), within[lang, source]
            for at in range(0, max(1, len(terms)), 50_000):
                some = terms[at : at + 50_000]
                one = [*some, None] if at == 0 else some
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(one), pa.string()), pa.array([source] * len(one), pa.string()), pa.array(one, pa.binary()).cast(pa.string()), pa.array([found[t] for t in one], pa.int64()), pa.array([d[t] for t in one], pa.int64())],
                    names=["lang", "source", "term", "n", "d"],
                )

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            n = count[lang, source]
            before, distinct = len(n), set()
            for terms in terms_of(text):
                n.update(terms)
                distinct.update(terms)
            within[lang, source].update(distinct)
            size += len(n) - before
            if size > HELD:
                yield from rows()
                count.clear()
                within.clear()
                size = 0
    yield from rows()


def _dictionary(batches):
    """Rows (lang, low, size, terms): sorted kept terms in chunks, each named by its first term."""
    key, held, n = None, [], 0

    def close():
        terms = np.concatenate(held)
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([terms[0].decode()]), pa.array([len(terms)], pa.int64()), pa.array([b" ".join(terms.tolist())], pa.binary())], names=["lang", "low", "size", "terms"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        terms = np.array(batch.column("term").cast(pa.binary()).to_pylist(), object)
        edge = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
        for a, b in zip(edge, edge[1:]):
            if a < b and key is not None and key != langs[a]:
                yield close()
                held, n = [], 0
            while a < b:
                key, end = langs[a], min(b, a + CHUNK - n)
                held.append(terms[a:end])
                n, a = n + end - a, end
                if n == CHUNK:
                    yield close()
                    key, held, n = None, [], 0
    if held:
        yield close()


def _bounds(lows: list[tuple[str, str]]):
    """For each language the sorted first terms of its chunks."""
    found: dict[str, list[bytes]] = defaultdict(list)
    for lang, low in lows:
        found[lang].append(low.encode())
    return {lang: sorted(low) for lang, low in found.items()}


def _place(bounds):
    """Adds to rows (lang, source, term, n) the chunk in which the term is to be looked up."""

    def run(batches):
        for batch in batches:
            lows = []
            for lang, term in zip(batch.column("lang").to_pylist(), batch.column("term").cast(pa.binary()).to_pylist()):
                own = bounds.value[lang]
                lows.append(own[max(0, bisect_right(own, term) - 1)])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(lows, pa.binary()).cast(pa.string()), batch.column("source"), batch.column("term"), batch.column("n")], names=["lang", "low", "source", "term", "n"])

    return run


def _vectors(batches):
    """From rows sorted by (lang, low, source), a chunk's dictionary first: its dense vector of counts for each group, and for the language."""
    at = source = terms = None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    names = ["lang", "low", "source", "whole", "vector"]

    def row(name, vector):
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([name], pa.string()), pa.array([name is None]), pa.array([vector.tobytes()], pa.binary())], names=names)

    def close():
        ids = np.searchsorted(terms, np.concatenate([t for t, _ in found]))
        n = np.concatenate([n for _, n in found])
        return np.bincount(ids, n, len(terms)).astype(np.int64)  # a term is there once a group, so the sums are exact below 2 ** 53

    whole = None
    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in ("lang", "low", "source")]
        keys = list(zip(*rows))
        packed = batch.column("terms")
        n = batch.column("n").to_numpy(zero_copy_only=False)
        words = np.array(batch.column("term").cast(pa.binary()).to_pylist(), object)
        edge = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(edge, edge[1:]):
            if a == b:
                continue
            if (*(at or ()), source) != keys[a] and found:
                vector = close()
                whole += vector
                yield row(source, vector)
                found = []
            if at != keys[a][:2]:
                if whole is not None:
                    yield row(None, whole)
                at, terms = keys[a][:2], np.array(packed[a].as_py().split(b" "), object)
                whole = np.zeros(len(terms), np.int64)
            source = keys[a][2]
            if source is not None:
                found.append((words[a:b], n[a:b].astype(np.int64)))
    if found:
        vector = close()
        whole += vector
        yield row(source, vector)
    if whole is not None:
        yield row(None, whole)


def _best(batches):
    """Rows (lang, source, term, value) of the best terms of a group in a chunk."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            vector, every = (np.frombuffer(r[c], np.int64) for c in ("vector", "every"))
            p, q = shares(vector, r["total"], r["v"]), shares(every, r["lang_total"], r["v"])
            at = np.flatnonzero((vector > 0) & (p > q))
            f = (p - q)[at]
            best = np.lexsort((at, -f))[:TOP]  # ids are in the order of UTF-8
            terms = r["terms"].split(b" ") if len(best) else []
            out += [(r["lang"], r["source"], terms[i].decode(), x) for i, x in zip(at[best].tolist(), f[best].tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["lang", "source", "item", "value"])


def _stack(batches):
    """Rows (lang, low, block, size, sources, totals, matrix) from rows sorted by (lang, low, block): the vectors of a block of groups."""
    key, held = None, []

    def close():
        matrix = np.concatenate([np.frombuffer(r["vector"], np.int64) for r in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([key[1]]), pa.array([key[2]], pa.int64()), pa.array([len(matrix) // len(held)], pa.int64()), pa.array([[r["source"] for r in held]]), pa.array([[r["total"] for r in held]], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())],
            names=["lang", "low", "block", "size", "sources", "totals", "matrix"],
        )

    for batch in batches:
        for r in batch.to_pylist():
            if key != (r["lang"], r["low"], r["block"]):
                if held:
                    yield close()
                key, held = (r["lang"], r["low"], r["block"]), []
            held.append(r)
    if held:
        yield close()


def _distances(batches):
    """For two blocks of groups and a chunk: rows (lang, source, item, value) of the summed differences of their shares."""
    for batch in batches:
        for r in batch.to_pylist():
            sides = []
            for s in "ab":
                counts = np.frombuffer(r[f"{s}_matrix"], np.int64).reshape(len(r[f"{s}_sources"]), -1)
                sides.append(np.stack([shares(c, t, r["v"]) for c, t in zip(counts, r[f"{s}_totals"])]))
            values = [np.abs(sides[1] - p).sum(axis=1) for p in sides[0]]
            out = [(r["lang"], x, y, int(v)) for x, row in zip(r["a_sources"], values) for y, v in zip(r["b_sources"], row) if x != y]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: the distances between the sources of a language, and the terms that set each apart.

    Terms are counted once a (lang, source) group in the tasks that read the texts; a language keeps those that occur in
    ``documents`` of its documents. The kept terms are sorted and cut into chunks, whose first terms are all that every task
    knows of them. A count finds its chunk there and its id in the chunk's sorted array, and a group's counts in a chunk become a dense vector
    by bincount. Ids are in the order of the terms' UTF-8, so equal values need no further order. All numbers are whole.

    A group is every (lang, source) that occurs, also without a kept term. Part ``pair`` has a row for each other source of the language,
    part ``term`` the best ``TOP`` terms that occur in the group and have a larger share there than in the language.
    Null texts, languages and sources count as empty; rows that repeat count each time; an empty table gives an empty
    result. Texts are read whole; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = map_batches(texts, _count, "lang string, source string, term string, n long, d long")
    counted = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    groups = counted.where("term is null").select("lang", "source")
    kept = cut(counted.where("term is not null").groupBy("lang", "term").agg(F.sum("d").alias("d")).where(F.col("d") >= documents).select("lang", "term"))
    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    chunks = cut(ordered.mapInArrow(_dictionary, "lang string, low string, size long, terms binary"))
    sizes = groups.select("lang").distinct().join(chunks.groupBy("lang").agg(F.sum("size").alias("v")), "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"))

    bounds = spark.sparkContext.broadcast(_bounds(chunks.select("lang", "low").collect()))  # a term for each CHUNK
    own = counted.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n")
    placed = own.mapInArrow(_place(bounds), "lang string, low string, source string, term string, n long")
    none = lambda kind: F.lit(None).cast(kind)
    both = placed.withColumn("terms", none("binary")).union(chunks.select("lang", "low", none("string"), none("string"), none("long"), "terms"))
    both = both.repartition("lang", "low").sortWithinPartitions("lang", "low", F.asc_nulls_first("source"))
    vectors = cut(both.mapInArrow(_vectors, "lang string, low string, source string, whole boolean, vector binary"))

    totals = cut(groups.join(own.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(sizes, "lang").select("lang", "source", "v", F.coalesce("n", F.lit(0)).alias("total")))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    every = vectors.where("whole").select("lang", "low", F.col("vector").alias("every")).join(chunks, ["lang", "low"])
    grouped = vectors.where("not whole").select("lang", "low", "source", "vector").join(totals, ["lang", "source"]).join(langs.select("lang", "lang_total"), "lang")
    best = grouped.join(every, ["lang", "low"]).mapInArrow(_best, "lang string, source string, item string, value long")

    # A group without kept terms in a chunk has zeros there.
    ways = langs.select("lang", F.ceil(F.col("sources") / BLOCK).cast("long").alias("ways"))
    full = totals.join(ways, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("ways"))).join(chunks.select("lang", "low", "size"), "lang")
    zeros = F.expr("cast(repeat(decode(unhex('0000000000000000'), 'UTF-8'), cast(size as int)) as binary)")
    full = full.join(vectors.where("not whole").select("lang", "low", "source", "vector"), ["lang", "low", "source"], "left").withColumn("vector", F.coalesce("vector", zeros))
    stacked = full.select("lang", "low", "block", "source", "total", "vector").repartition("lang", "low", "block").sortWithinPartitions("lang", "low", "block")
    stacked = cut(stacked.mapInArrow(_stack, "lang string, low string, block long, size long, sources array<string>, totals array<long>, matrix binary"))
    side = lambda s: stacked.select("lang", "low", F.col("block").alias(f"{s}_block"), *[F.col(c).alias(f"{s}_{c}") for c in ("sources", "totals", "matrix")])
    tiles = side("a").join(side("b"), ["lang", "low"]).join(sizes, "lang")
    apart = tiles.mapInArrow(_distances, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(apart, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = best.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).union(ranked)


ORACLE = r"""
with doc as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
word as (select row, lang, source, unnest(w) as term from doc),
kept as (select lang, term from word group by lang, term having count(distinct row) >= 30),
grp as (select distinct lang, source from doc),
v as (select l.lang, count(term) as v from (select distinct lang from doc) l left join kept k on k.lang = l.lang group by l.lang),
n as (select lang, source, term, count(*) as n from word semi join kept using (lang, term) group by all),
cell as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) as n
  from grp g join kept k using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = k.term),
total as (select g.lang, g.source, coalesce(sum(n), 0) as total from grp g left join n using (lang, source) group by all),
share as (
  select lang, source, term, n, cast(1 + (1000000000 * (n::hugeint + 5)) // (total::hugeint + 5 * v) as bigint) as p
  from cell join total using (lang, source) join v using (lang)),
whole as (
  select lang, term, cast(1 + (1000000000 * (sum(n)::hugeint + 5)) // (t::hugeint + 5 * v) as bigint) as q
  from cell join (select lang, sum(total) as t from total group by lang) using (lang) join v using (lang) group by lang, term, t, v),
apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, p - q as value from share join whole using (lang, term) where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 50
"""
