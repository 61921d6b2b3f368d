"""Nearest neighbours: recall against brute force, both ways of meeting the codes, ties, copies and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import neighbours

DDL = "vec_id long, embedding array<double>, label int, score double, cid long, rank int"


def plain(rows, k=20, every=20):
    """All rows compared, equal vectors with equal scores."""
    good = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (q, v) in enumerate(good):
        if q % every == 0:
            scored = sorted(((-sum(x * y for x, y in zip(v, w)), j) for n, (j, w) in enumerate(good) if n != at and len(w) == len(v)))[:k]
            out += [(q, i + 1, j, -s) for i, (s, j) in enumerate(scored)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 7, 8) for i, v in rows], DDL)


def clustered(n=3000, d=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, d)) * 3
    at = rng.integers(0, 40, n)
    at[: n // 3] = 0
    return [(i, v.tolist()) for i, v in enumerate(centres[at] + rng.standard_normal((n, d)) * 0.05)]


def recall(got, want):
    return len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) / len(want)


def test_recall_and_both_ways(spark):
    """Clusters, a third of all rows in one: probing and comparing all codes meet the same ones, whole buckets or parts of them."""
    rows = clustered()
    want = plain(rows)
    ways = {w: sorted(tuple(r) for r in neighbours.nearest(table(spark, rows), way=w).collect()) for w in ("probe", "scan")}
    assert len(ways["scan"]) == len(want) and recall(ways["scan"], want) >= 0.9
    assert [r[:3] for r in ways["probe"]] == [r[:3] for r in ways["scan"]]
    np.testing.assert_allclose([r[3] for r in ways["probe"]], [r[3] for r in ways["scan"]], rtol=1e-12)


@pytest.mark.parametrize("radius", [0, 3, 9, 20])
def test_every_code_within_the_radius_is_met(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (4, 2)).astype(np.uint64)
    codes = base[rng.integers(0, 4, 400)]
    flips = np.zeros((400, 128), np.uint8)
    for i in range(400):
        flips[i, rng.choice(128, rng.integers(0, 14), replace=False)] = 1
    codes = codes ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    rows = [(i, i, [float(i), 1.0], bytearray(c.tobytes())) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "cid long, least long, embedding array<double>, code binary")
    got = {(r["query"], r.cid): r.distance for r in neighbours.probe(df, df.where(F.col("cid") % 20 == 0), radius, 400, 50).collect()}
    distance = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
    assert got == {(q, c): distance[q, c] for q in range(0, 400, 20) for c in range(400) if distance[q, c] <= radius}


def test_different_norms(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1500, 16)) * rng.lognormal(0, 0.5, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got, want = [tuple(r) for r in neighbours.nearest(table(spark, rows)).collect()], plain(rows)
    assert len(got) == len(want) and recall(got, want) >= 0.9


def test_ties_copies_and_odd_vectors(spark):
    """Few rows are all compared: the result is exact."""
    one, two = [1.0, 0.0, 2.0], [0.0, 1.0, 1.0]
    rows = [(i, one) for i in range(60, 0, -1)] + [(i, two) for i in range(100, 111)] + [(40, one), (40, two), (None, one), (200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 1.0]), (280, [1.0, float("nan"), 0.0]), (300, [float("inf"), 1.0, 1.0])]
    rows += [(320, [1.0, 2.0]), (321, [2.0, 1.0]), (340, [5.0]), (0, [-0.0, 1.0, 1.0]), (-20, [-1.0, 0.0, 0.0])]
    got = sorted(tuple(r) for r in neighbours.nearest(table(spark, rows)).collect())
    assert got == plain(rows)
    small = sorted(tuple(r) for r in neighbours.nearest(table(spark, rows), k=3).collect())
    assert small == plain(rows, 3)


def test_copies_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HOT", 2)
    rows = [(i, [1.0, float(i % 3)]) for i in range(200)]
    assert sorted(tuple(r) for r in neighbours.nearest(table(spark, rows)).collect()) == plain(rows)


def test_nothing(spark):
    empty = neighbours.nearest(table(spark, [(1, [1.0])]).limit(0))
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert neighbours.nearest(table(spark, [(20, None), (40, [0.0])])).count() == 0
    assert neighbours.nearest(table(spark, [(20, [1.0])])).count() == 0
    assert neighbours.nearest(table(spark, [(1, [1.0]), (2, [2.0])])).count() == 0


def test_long_vectors_have_codes_of_their_leading_components():
    x = np.random.default_rng(0).standard_normal((300, 400)) * np.linspace(2, 0.1, 400)
    model = neighbours.fit(x, float(np.sqrt((x * x).sum(1)).max()))
    codes = neighbours.encode(model, x)
    assert codes.shape == (300, 2) and len(np.unique(codes, axis=0)) > 290
