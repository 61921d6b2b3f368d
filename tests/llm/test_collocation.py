"""Phrases against plain counting, with hard texts, tiny filters and odd tables."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import collocation

DDL = "doc_id long, text string, lang string, source string, n_chars long, phrase string, n long, f long, a long"


def plain(rows, least, covered=80):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for n in (1, 2, 3, 4):
                counts["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        parts = lambda p: {p[i : i + m] for m in range(2, len(p)) for i in range(len(p) - m + 1)}
        gone = {q for p, a in found.items() for q in parts(p) if q in found and 100 * a >= covered * found[q]}
        scored = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:2000])]
    return sorted(out)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "own", 2, 3, 4) for i, (t, lang) in enumerate(rows)], DDL)


HARD = [
    (None, "en"), ("", "en"), (None, None), ("...;!", "en"), ("a a a a a a a. b", "en"), ("New york City, new york city! New\tyork  city", None), ("New york CITY", "und"),
    ("x\x00y z\x1cw x\x00y z\x1cw x\x00y z\x1cw", "fr"), ("Éa ÉA éa éa. ß ß ß\x0bß ß", "fr"), ("a b c a b c", ""), ("日本 語 日本 語、日本 語", "ja"), ("one two three four five " * 400, "de"), ("one two three four five " * 400, "de"),
]


@pytest.mark.parametrize("bits", [collocation.BITS, 15])
def test_hard_texts(spark, bits):
    """With a filter of few bits more is counted, and the result is the same."""
    for least in (1, 2, 3):
        got = sorted(tuple(r) for r in collocation.mine(rows_of(spark, HARD), least=least, bits=bits).collect())
        assert got == plain(HARD, least)


def test_many_phrases_in_small_chunks(spark, monkeypatch):
    words = ["w%d" % (i * i % 17) for i in range(6000)]
    rows = [(" ".join(words[i : i + 37]) + ("," if i % 3 else ""), "en" if i % 5 else "de") for i in range(0, 6000, 9)]
    want = plain(rows, 30)
    assert len(want) > 30 and [tuple(r) for r in collocation.mine(rows_of(spark, rows)).orderBy("lang", "rank").collect()] == sorted(want)
    counter = collocation._Counter("en", (1, 2, 3, 4), None, None)
    monkeypatch.setattr(collocation, "CHUNK_VOCABULARY", 5)
    monkeypatch.setattr(collocation, "_EMIT", 7)
    monkeypatch.setattr(collocation, "_SLICE", 11)
    found = collections.Counter()
    for text, _ in rows:
        counter.add(text.encode())
        for batch in counter.counts():
            for r in batch.to_pylist():
                found[r["n"], r["phrase"]] += r["f"]
    want = collections.Counter()
    for text, _ in rows:
        for piece in text.split(","):
            w = piece.split()
            want.update((n, " ".join(w[i : i + n])) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
    assert found == want


def test_limit_and_ties(spark):
    rows = [(f"x{i:04d} y{i:04d}", "en") for i in range(2100) for _ in range(2)]
    got = collocation.mine(rows_of(spark, rows), least=2).orderBy("rank").collect()
    assert [(r.rank, r.phrase) for r in got] == [(i + 1, f"x{i:04d} y{i:04d}") for i in range(2000)] and {r.score for r in got} == {1_000_000}


def test_nothing(spark):
    empty = collocation.mine(rows_of(spark, HARD).limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocation.mine(rows_of(spark, [(None, None), ("", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    """The expression of the score, on counts whose product with the scale passes 64 bits."""
    a, left, right = 7_000_000_000_000_000_001, 7_100_000_000_000_000_003, 7_200_000_000_000_000_009
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    got = row.select(F.expr(f"cast(a as decimal(20, 0)) * {collocation.SCALE} div (cast(l as decimal(20, 0)) + r)").alias("s")).first().s
    assert got == collocation.SCALE * a // (left + right)


def test_filter_holds_all_that_is_frequent(spark):
    words = [f"w{i}" for i in range(300)]
    bits = collocation._filter(spark.createDataFrame([("en", w) for w in words], "lang string, phrase string"), 15)
    assert collocation._set(bits, collocation._word_hashes("en", [w.encode() for w in words])).all()
    pairs = [(a, b) for a, b in itertools.pairwise(words)]
    bits = collocation._filter(spark.createDataFrame([("en", f"{a} {b}") for a, b in pairs], "lang string, phrase string"), 16)
    side = lambda k: collocation._word_hashes("en", [p[k].encode() for p in pairs])
    assert collocation._set(bits, collocation._pair_hashes(side(0), side(1))).all() and collocation._set(bits, collocation._pair_hashes(side(1), side(0))).mean() < 0.1
