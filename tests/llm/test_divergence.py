"""The audit of sources against plain counting, and its arithmetic at its bounds."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import divergence

DDL = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, low string, rank int"


def plain(rows, documents=30, top=50):
    docs = [("" if t is None else t, "" if x is None else x, "" if s is None else s) for t, x, s in rows]
    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for t, _, _ in docs]
    out = []
    for lang in {x for _, x, _ in docs}:
        mine = [(s, w) for (_, x, s), w in zip(docs, words) if x == lang]
        df = collections.Counter(t for _, w in mine for t in set(w))
        kept = sorted(t for t in df if df[t] >= documents)
        count = collections.defaultdict(collections.Counter)
        for s, w in mine:
            count[s].update(t for t in w if df[t] >= documents)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(count[s]) for s in count}, share(sum(count.values(), collections.Counter()))
        for s in count:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "own", 2, "own", 3) for i, r in enumerate(rows)], DDL)


HARD = [
    (None, "en", "a"), ("", "en", "b"), (None, None, None), ("12 ... 34", None, "c"), ("Éa éa EA ea", "en", "a"), ("ea 日本 é", "en", "b"), ("one one two", "en", "a"), ("one [two] {three}", "en", "d"),
    ("only", "v1", "a"), ("only", "v1", "a"), ("only only", "v1", "b"), ("nothing here", "v1", "c"), ("zz \x00 zz\x7fzz", "en", "\U0001f600"), ("tie tié tie", "fr", "x"), ("￮ \U0001f600 tie", "fr", "y"), ("￮ \U0001f600", "fr", "x"), ("lorem ipsum " * 9000, "en", "b"),
]


@pytest.mark.parametrize("documents", [1, 2, 100])
def test_hard_rows(spark, documents):
    """Nulls, ties, groups without terms, one kept term, none."""
    want = plain(HARD, documents)
    assert sorted(tuple(r) for r in divergence.audit(rows_of(spark, HARD), documents).collect()) == want


def test_many_terms(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "aébzßy" for b in "klmnopqrst" for c in "uvwxé"]
    rows = [(" ".join(rng.choice(words, 25, p=np.arange(1, 301) / 45150)), "en" if i % 4 else "de", f"src{i % 7}") for i in range(800)]
    assert sorted(tuple(r) for r in divergence.audit(rows_of(spark, rows)).collect()) == plain(rows)


def test_dictionary_in_small_chunks(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 3)
    terms = [f"t{i}" for i in range(8)]
    batches = [pa.RecordBatch.from_pydict({"lang": ["a"] * 5 + ["b"], "term": terms[:5] + ["t0"]}), pa.RecordBatch.from_pydict({"lang": ["b"] * 7, "term": terms[1:]})]
    got = [r for b in divergence._dictionary(batches) for r in b.to_pylist()]
    assert [(r["lang"], r["low"], r["size"], r["terms"]) for r in got] == [("a", "t0", 3, b"t0 t1 t2"), ("a", "t3", 2, b"t3 t4"), ("b", "t0", 3, b"t0 t1 t2"), ("b", "t3", 3, b"t3 t4 t5"), ("b", "t6", 2, b"t6 t7")]


def test_nothing(spark):
    empty = divergence.audit(rows_of(spark, HARD).limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_are_exact():
    rng = np.random.default_rng(5)
    for total, v in ((0, 1), (10**3, 7), (10**9, 10**6), (8 * 10**15, 10**9), (9 * 10**17, 5)):
        counts = np.unique(np.append(rng.integers(0, total + 1, 200), [0, total]))
        assert divergence.shares(counts, total, v).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * v) for c in counts]
