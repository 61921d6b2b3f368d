"""Embedding near-dedup: int8 tile products with rigorous error bounds, double precision where in doubt."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few
from .components import connected_components, local_labels

THRESHOLD = 0.95
#: Vectors aimed at in a block; a tile is the product of two blocks.
BLOCK = 4096
#: Copies of a vector beyond which its class is broadcast to them instead of shuffled with them.
HOT = 100_000
#: Slack for the float32 arithmetic on the bounds (their rounding stays below 1e-5).
SLACK = 2e-5


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, int8 codes of what they leave, facts) of the unit vectors of the rows of a matrix.

    A unit vector u is s q + e, and s q + (s / 254) r + f with the second codes r. The facts of a row
    are s and the Euclidean norms of s q, of e, of s q + (s / 254) r, and of f, so that
    |u.v - s_u s_v q_u.q_v| <= |s_u q_u| |e_v| + |s_v q_v| |e_u| + |e_u| |e_v|, and likewise with r.
    """
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    coarse = codes * scale[:, None]
    rest = np.clip(np.rint((unit - coarse) / (scale[:, None] / 254)), -127, 127)
    fine = coarse + rest * (scale[:, None] / 254)
    norm = lambda m: np.sqrt((m * m).sum(axis=1))
    facts = np.column_stack([scale, norm(coarse), norm(unit - coarse) + 1e-12, norm(fine), norm(unit - fine) + 1e-12])
    return codes.astype(np.int8), rest.astype(np.int8), facts


def tile_pairs(a, b, same: bool, threshold: float = THRESHOLD, step: int = 1024):
    """(i, j, sure) for pairs of two quantised blocks that may reach a cosine of ``threshold``; pairs that are not sure need the vectors.

    For a block with itself i < j. The int8 products are summed in float32, which is exact for them
    (below 2 ** 24 for up to 1040 components, in pieces beyond); pairs whose upper bound reaches
    the threshold are bounded again with the second codes, in double precision.
    """
    (qa, ra, fa), (qb, rb, fb) = a, b
    (sa, na, ea, ma, da), (sb, nb, eb, mb, db) = fa.T, fb.T
    right = qb.astype(np.float32).T
    for at in range(0, len(qa), step):
        rows = slice(at, at + step)
        bound = np.zeros((len(qa[rows]), len(qb)), np.float32)
        for k in range(0, qa.shape[1], 1024):
            bound += qa[rows, k : k + 1024].astype(np.float32) @ right[k : k + 1024]
        bound *= sa[rows, None].astype(np.float32)
        bound *= sb[None, :].astype(np.float32)
        bound += np.outer(na[rows] + ea[rows], eb).astype(np.float32)
        bound += np.outer(ea[rows], nb).astype(np.float32)
        i, j = np.nonzero(bound >= np.float32(threshold - SLACK))
        i += at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        for k in range(0, len(i), 100_000):
            x, y = i[k : k + 100_000], j[k : k + 100_000]
            u = qa[x] * sa[x, None] + ra[x] * (sa[x, None] / 254)
            v = qb[y] * sb[y, None] + rb[y] * (sb[y, None] / 254)
            cosine = np.einsum("ij,ij->i", u, v)
            error = ma[x] * db[y] + mb[y] * da[x] + da[x] * db[y] + 1e-12
            maybe = cosine + error >= threshold
            if maybe.any():
                yield x[maybe], y[maybe], (cosine - error >= threshold)[maybe]


def _valid(c: str = "embedding"):
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(c, lambda v: v != 0), F.lit(False))


def _pack(batches):
    """One row for each block: class ids, multiplicities, codes and facts as binaries. Vectors are quantised here, once."""
    key, held = None, []
    names = ("dim", "block", "cid", "m", "codes", "rest", "facts")

    def close():
        parts = [np.concatenate([h[k] for h in held]) for k in range(5)]
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=names)

    for batch in batches:
        dim, block, cid, m = (batch.column(n).to_numpy(zero_copy_only=False) for n in names[:4])
        vectors = batch.column("embedding")
        edge = np.flatnonzero((np.diff(dim) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(dim)]):
            if a == b:
                continue
            if key is not None and key != (dim[a], block[a]):
                yield close()
                held.clear()
            key = (int(dim[a]), int(block[a]))
            flat = vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            held.append((cid[a:b], m[a:b], *quantise(flat.reshape(b - a, -1))))
    if held:
        yield close()


def _tile(threshold: float):
    """For a pair of blocks: rows (a, b, n) of links that span local components, with link counts, and rows (a, b, ma, mb) of pairs in doubt."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "n", "ma", "mb")])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                same, dim = row["i"] == row["j"], row["dim"]
                sides = []
                for s in "ab"[: 1 if same else 2]:
                    cid, m = (np.frombuffer(row[f"{s}_{c}"], np.int64) for c in ("cid", "m"))
                    codes = [np.frombuffer(row[f"{s}_{c}"], np.int8).reshape(-1, dim) for c in ("codes", "rest")]
                    sides.append((cid, m, (*codes, np.frombuffer(row[f"{s}_facts"], np.float64).reshape(-1, 5))))
                (ca, ma, qa), (cb, mb, qb) = sides[0], sides[-1]
                shift = 0 if same else len(ca)
                cid = ca if same else np.concatenate([ca, cb])
                weight = ma if same else np.concatenate([ma, mb])
                count, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
                for i, j, sure in tile_pairs(qa, qb, same, threshold):
                    j = j + shift
                    x, y = i[~sure], j[~sure]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(cid[x]), pa.array(cid[y]), pa.nulls(len(x), pa.int64()), pa.array(weight[x]), pa.array(weight[y])], schema=schema)
                    i, j = i[sure], j[sure]
                    count += np.bincount(i, weight[j], len(cid)).astype(np.int64) + np.bincount(j, weight[i], len(cid)).astype(np.int64)
                    star = np.flatnonzero(label != np.arange(len(cid)))
                    label = local_labels(len(cid), np.concatenate([i, star]), np.concatenate([j, label[star]]))
                hit = np.flatnonzero(count)
                if len(hit):
                    none = pa.nulls(len(hit), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(cid[label[hit]]), pa.array(count[hit]), none, none], schema=schema)

    return run


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns in double precision; vectors are brought to a largest component of one first."""

    def unit(c: str) -> Column:
        top = F.array_max(F.transform(c, lambda v: F.abs(v.cast("double"))))
        return F.transform(c, lambda v: v.cast("double") / top)

    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda v, w: v * w))
    x, y = unit(a), unit(b)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``.

    Two vectors link at a cosine of at least ``threshold`` in double precision. Equal vectors form one
    class that is compared once and counts with its size, so copies are never expanded into pairs.
    Classes are dealt into blocks and quantised once; what is shuffled of a vector are its int8 codes. Each
    pair of blocks is one tile, and all tiles are computed: the comparison is exact, its work grows with the
    square of the number of distinct vectors, and a task holds two blocks. From a tile come link counts and
    links that span its local components, and the few pairs that the bounds leave in doubt: for these alone
    the vectors are fetched.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so
    do vectors of different lengths. Rows that repeat a vec_id are vectors of their own.
    ``component_id`` is the smallest vec_id reachable, itself included; a null vec_id is ignored there
    and not kept. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select("vec_id", "embedding").withColumn("ok", _valid())
    good = rows.where("ok").select("vec_id", "embedding")
    classes = good.groupBy("embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding").cast("long")))
    sizes = classes.groupBy("dim").count()
    ways = sizes.select("dim", F.greatest(F.lit(1), F.ceil(F.col("count") / block)).cast("long").alias("ways"))
    dealt = classes.join(ways, "dim").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("ways")))
    dealt = dealt.select("dim", "block", "cid", "m", "embedding").repartition("dim", "block").sortWithinPartitions("dim", "block")
    packed = cut(dealt.mapInArrow(_pack, "dim long, block long, cid binary, m binary, codes binary, rest binary, facts binary"))
    tiles = packed.select("dim", F.col("block").alias("i")).join(ways, "dim").select("dim", "i", F.explode(F.sequence("i", F.col("ways") - 1)).alias("j"))
    side = lambda s, k: packed.select("dim", F.col("block").alias(k), *[F.col(c).alias(f"{s}_{c}") for c in ("cid", "m", "codes", "rest", "facts")])
    joined = tiles.join(side("a", "i"), ["dim", "i"]).join(side("b", "j"), ["dim", "j"])
    every = cut(joined.mapInArrow(_tile(threshold), "a long, b long, n long, ma long, mb long"))
    vector = lambda k: classes.select(F.col("cid").alias(k), F.col("embedding").alias(f"{k}_vector"))
    doubt = every.where("n is null").select("a", "b", "ma", "mb").join(vector("a"), "a").join(vector("b"), "b")
    settled = cut(doubt.where(cosine("a_vector", "b_vector") >= threshold).select("a", "b", "ma", "mb"))
    sure = every.where("n is not null")
    found = sure.select("a", "b").union(settled.select("a", "b"))
    counts = sure.select("a", "n").union(settled.select("a", "mb")).union(settled.select("b", "ma"))
    linked = counts.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cid")
    roots = connected_components(found).withColumnRenamed("node", "cid")
    placed = classes.join(linked, "cid", "left").join(roots, "cid", "left").select("embedding", "m", "least", F.coalesce("root", "cid").alias("root"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = cut(placed.join(least, "root").select("embedding", "m", "n_links", "component_id"))
    result = good.join(placed.where(F.col("m") <= HOT), "embedding").select("vec_id", "n_links", "component_id")
    hot = few(placed.where(F.col("m") > HOT))  # at most one for each HOT rows
    if not hot.isEmpty():
        result = result.union(good.join(hot, "embedding").select("vec_id", "n_links", "component_id"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def tiles_of(n: int, block: int = BLOCK) -> int:
    """Tiles that ``n`` distinct vectors take."""
    b = math.ceil(n / block)
    return b * (b + 1) // 2
