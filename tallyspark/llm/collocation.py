"""Phrase collocations: all n-grams of each language counted as rows, scored in whole numbers, covered phrases dropped."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches

#: Words of the longest phrase.
MAX_WORDS = 4
#: Occurrences that a candidate has at least.
LEAST = 30
#: Phrases returned for each language.
TOP = 2000
#: A candidate goes if a longer one has at least this share of its occurrences, in percent.
COVERED = 80
#: A score is SCALE * a / (l + r), rounded down.
SCALE = 2_000_000
#: A filter has 2 ** BITS bits, 8 MB, whatever the corpus: that is all that is broadcast.
BITS = 26
_BLOCK = 15
#: Words of text that a task counts at once, and distinct words that it remembers.
CHUNK_WORDS, CHUNK_VOCABULARY = 700_000, 200_000
_EMIT = 50_000
_SLICE = 4_000_000

#: A to Z lower-cased, tabs as blanks, the ends of pieces as 0xff, which UTF-8 never has.
_PIECES = bytes(0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _word_hashes(lang: str, words) -> np.ndarray:
    seed = _seed(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * _ODD + second
    return mixed ^ (mixed >> np.uint64(29))


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter has the hashes; all are let through without one."""
    if bits is None:
        return np.ones(len(hashes), bool)
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _filter(frequent: DataFrame, bits: int = BITS) -> np.ndarray:
    """A filter of the frequent words or pairs of ``frequent(lang, phrase)``: a bit for each hash. It lets more through, never less."""

    def places(batches):
        for batch in batches:
            langs, phrases = np.array(batch.column("lang").to_pylist(), object), batch.column("phrase").cast(pa.binary()).to_pylist()
            for lang in dict.fromkeys(langs):
                words = [p.split(b" ") for p, x in zip(phrases, langs) if x == lang]
                found = _word_hashes(lang, (w[0] for w in words))
                if len(words[0]) == 2:
                    found = _pair_hashes(found, _word_hashes(lang, (w[1] for w in words)))
                at = (found & np.uint64((1 << bits) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> _BLOCK), pa.array(at & ((1 << _BLOCK) - 1))], names=["block", "bit"])

    def packed(batches):
        for batch in batches:
            rows = []
            for found in batch.column("bits"):
                block = np.zeros(1 << _BLOCK, np.uint8)
                block[found.values.to_numpy()] = 1
                rows.append(np.packbits(block, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(rows, pa.binary())], names=["block", "packed"])

    blocks = frequent.select("lang", "phrase").mapInArrow(places, "block long, bit long").distinct().groupBy("block").agg(F.collect_set("bit").alias("bits"))
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in blocks.mapInArrow(packed, "block long, packed binary").collect():
        at = r["block"] << (_BLOCK - 3)
        whole[at : at + (1 << (_BLOCK - 3))] = np.frombuffer(r["packed"], np.uint8)
    return whole


class _Counter:
    """Counts the n-grams of a stream of texts of one language, a chunk at a time."""

    def __init__(self, lang: str, lengths, word_bits, pair_bits):
        self.lang, self.lengths, self.word_bits, self.pair_bits = lang, lengths, word_bits, pair_bits
        self.forget()

    def forget(self) -> None:
        self.held, self.n = [], 0
        self.vocabulary = defaultdict(itertools.count().__next__)
        self.vocabulary[b"\xff"]  # the end of a piece is word 0
        self.hashes = np.zeros(0, np.uint64)

    def add(self, text: bytes) -> None:
        text, at = text.translate(_PIECES).replace(b"\xff", b" \xff "), 0
        while at < len(text):
            end = text.find(b" ", at + _SLICE)
            end = len(text) if end < 0 else end
            words = text[at:end].split()
            self.held.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)))
            self.n, at = self.n + len(words), end
        self.held.append(np.zeros(1, np.int64))

    def counts(self):
        """Record batches (lang, n, phrase, f) of what has been added since the last call."""
        ids, words = np.concatenate([*self.held, np.zeros(1, np.int64)]), list(self.vocabulary)
        if self.lengths != (1,):
            self.hashes = np.concatenate([self.hashes, _word_hashes(self.lang, words[len(self.hashes) :])])
        texts = pa.array([b"", *words[1:]], pa.binary()).cast(pa.string())
        for n, parts, f in self._grams(ids, len(words)):
            for at in range(0, len(f), _EMIT):
                some = [texts.take(pa.array(p[at : at + _EMIT])) for p in parts]
                phrase = pc.binary_join_element_wise(*some, " ") if n > 1 else some[0]
                size = len(phrase)
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * size, pa.string()), pa.array(np.full(size, n, np.int32)), phrase, pa.array(f[at : at + _EMIT].astype(np.int64))], names=["lang", "n", "phrase", "f"])
        self.held, self.n = [], 0
        if len(words) > CHUNK_VOCABULARY:
            self.forget()

    def _grams(self, ids: np.ndarray, v: int):
        if 1 in self.lengths:
            found = np.bincount(ids, minlength=v)
            at = np.flatnonzero(found[1:]) + 1
            yield 1, [at], found[at]
        if max(self.lengths) == 1:
            return
        known = _set(self.word_bits, self.hashes)
        known[0] = False
        fine = known[ids]
        at = np.flatnonzero(fine[:-1] & fine[1:])
        keys, which, f = np.unique(ids[at] * v + ids[at + 1], return_inverse=True, return_counts=True)
        first, second = keys // v, keys % v
        if 2 in self.lengths:
            yield 2, [first, second], f
        if max(self.lengths) == 2:
            return
        often = _set(self.pair_bits, _pair_hashes(self.hashes[first], self.hashes[second]))
        pair = np.full(len(ids), -1, np.int64)  # the frequent pair that starts at a place
        pair[at] = np.where(often[which], which, -1)
        p = len(keys)
        three = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
        keys3, f3 = np.unique(pair[three] * v + second[pair[three + 1]], return_counts=True)
        yield 3, [first[keys3 // v], second[keys3 // v], keys3 % v], f3
        four = three[np.isin(three + 1, three, assume_unique=True)]
        keys4, f4 = np.unique(pair[four] * p + pair[four + 2], return_counts=True)
        yield 4, [first[keys4 // p], second[keys4 // p], first[keys4 % p], second[keys4 % p]], f4


def _counted(docs: DataFrame, lengths: tuple[int, ...], word_bits: np.ndarray | None = None, pair_bits: np.ndarray | None = None) -> DataFrame:
    """``(lang, n, phrase, f)``: the n-grams of the lengths, as rows that are summed by language.

    Of pairs only those of words that the first filter has are counted, of longer phrases those of pairs that the second has.
    """
    filters = docs.sparkSession.sparkContext.broadcast((word_bits, pair_bits))

    def run(batches):
        counters: dict[str, _Counter] = {}
        for batch in batches:
            texts: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if text:
                    texts[lang].append(text)
            for lang, some in texts.items():
                if lang not in counters:
                    counters[lang] = _Counter(lang, lengths, *filters.value)
                counters[lang].add(b"\xff".join(some))
            while sum(c.n for c in counters.values()) > CHUNK_WORDS:
                yield from max(counters.values(), key=lambda c: c.n).counts()
            if sum(len(c.vocabulary) for c in counters.values()) > 4 * CHUNK_VOCABULARY:
                for c in counters.values():
                    yield from c.counts()
                counters.clear()
        for c in counters.values():
            yield from c.counts()

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(texts, run, "lang string, n int, phrase string, f long").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))


def _first(phrase: str, k) -> Column:
    """Words up to the k-th blank from the left, or the right if k is negative."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), k)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, bits: int = BITS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of two to four words of each language of ``docs``.

    Every n-gram is a row that is summed by language. A phrase that occurs ``least`` times has no part that occurs less,
    so words come first, then pairs of frequent words, then longer phrases of frequent pairs; what is frequent is known to
    the tasks as a bit filter of fixed size, which may let more through but nothing less, and the sums decide. Counts of the parts of each
    cut are joined, the score is a division of decimals, and a candidate goes if one of a word more covers it: if a yet longer
    one does, so does the one of a word more inside that one, as it occurs at least as often.

    Null texts count as empty and null languages as ``und``, one language with those that are called so. Texts without words, and
    an empty table, give nothing. Rows that repeat count each time. Equal scores are ordered by occurrences and then by the
    bytes of the phrase. Texts are read whole; other columns are not read.
    """
    words = cut(_counted(docs, (1,)))
    frequent = words.where(F.col("f") >= least)
    word_bits = _filter(frequent, bits)
    pairs = cut(_counted(docs, (2,), word_bits).where(F.col("f") >= least))
    longer = cut(_counted(docs, (3, 4), word_bits, _filter(pairs, bits)).where(F.col("f") >= least))
    every = frequent.union(pairs).union(longer)
    phrases = pairs.union(longer).withColumnRenamed("f", "a")

    part = lambda name, f: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = phrases.select("lang", "n", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.withColumn("left", _first("phrase", F.col("k"))).withColumn("right", _first("phrase", F.col("k") - F.col("n")))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + r)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    scored = lowest.select("lang", "n", "phrase", "a", "m.score", "m.l", "m.r")

    inner = lambda phrase: longer.select("lang", phrase.alias("phrase"), F.col("f").alias("by"))
    over = inner(_first("phrase", F.col("n") - 1)).union(inner(_first("phrase", 1 - F.col("n")))).groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    kept = scored.join(over, ["lang", "phrase"], "left").where("by is null or cast(by as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * " + str(int(covered)))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("total"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


ORACLE = r"""
with piece as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
  from documents),
cut_up as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece),
gram as (
  select lang, n, array_to_string(w[i : i + n - 1], ' ') as phrase, count(*) as f
  from cut_up, unnest(range(1, 5)) as a(n), unnest(range(1, len(w) - n + 2)) as b(i) group by all),
total as (select lang, cast(sum(f) as bigint) as n from gram where n = 1 group by lang),
candidate as (select *, string_split(phrase, ' ') as w from gram where n > 1 and f >= 30),
divided as (
  select c.lang, c.n, c.phrase, c.f as a, k, x.f as l, y.f as r, cast((2000000 * c.f::hugeint) // (x.f::hugeint + y.f) as bigint) as score
  from candidate c, unnest(range(1, c.n)) as t(k)
  join gram x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : k], ' ') and x.n = k
  join gram y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1 : c.n], ' ') and y.n = c.n - k),
lowest as (select * from divided qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select c.lang, array_to_string(c.w[i : i + m - 1], ' ') as phrase, max(c.f) as f
  from candidate c, unnest(range(2, c.n)) as s(m), unnest(range(1, c.n - m + 2)) as t(i) group by all),
kept as (
  select p.* from lowest p left join inside c on c.lang = p.lang and c.phrase = p.phrase where c.f is null or 100 * c.f::hugeint < 80 * p.a::hugeint)
select lang, rank, phrase, a, l, r, n, score from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from kept) join total using (lang)
where rank <= 2000
"""
