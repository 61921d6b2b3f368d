"""Approximate nearest neighbours: learned rotated binary codes in a multi-index, pigeonhole probing, reranked by the vectors."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, few
from .embdedup import HOT, _valid

#: Neighbours of each query.
K = 20
#: Bits of a code, and of each of the substrings that are indexed.
BITS, SUB = 128, 16
PARTS = BITS // SUB
#: Vectors that the rotation is learned from, and queries that the radius is learned from.
FITTED, MEASURED = 20_000, 256
FITTED_BYTES = 64_000_000
#: Share of the measured queries' true neighbours that lie within the radius.
RECALL = 0.97
#: Bytes of vectors in a block, and codes in it at most; queries in a block.
BLOCK_BYTES, BLOCK_ROWS, QUERY_ROWS = 16_000_000, 16_384, 1024
#: Codes that are compared one after the other in the time of looking up one probe.
PROBE_COST = 300


def fit(sample: np.ndarray, largest: float, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, rotations, largest norm): what turns a vector into a code.

    A vector gets a component more that brings it to the largest norm (a query gets zero there), so that the largest inner
    product is the smallest angle. Its distances from the mean of the sample are rotated so that they lie close to the corners of a cube;
    each rotation gives as many bits as there are components, the leading ones of the sample if there are more than bits.
    """
    x = raised(sample, largest)
    mean = x.mean(axis=0)
    x = x - mean
    rng = np.random.default_rng(seed)
    _, _, axes = np.linalg.svd(x.T @ x)
    lead = axes[:BITS].T
    y = x @ lead
    d, turned = lead.shape[1], []
    for _ in range(math.ceil(BITS / d)):
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(y.T @ np.where(y @ turn > 0, 1.0, -1.0))
            turn = u @ v
        turned.append(lead @ turn)
    return mean, np.hstack(turned)[:, :BITS], largest


def raised(vectors: np.ndarray, largest: float) -> np.ndarray:
    vectors = vectors / largest
    left = np.sqrt(np.maximum(0.0, 1 - (vectors * vectors).sum(axis=1)))
    return np.hstack([vectors, left[:, None]])


def encode(model, vectors: np.ndarray, query: bool = False) -> np.ndarray:
    """Codes of the rows of a matrix, as two unsigned numbers of 64 bits each."""
    mean, turn, largest = model
    x = np.hstack([vectors / largest, np.zeros((len(vectors), 1))]) if query else raised(vectors, largest)
    return np.packbits((x - mean) @ turn > 0, axis=1, bitorder="little").view(np.uint64)


def _matrix(column) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _coded(model, query: bool):
    """Adds the code to rows (cid, least, embedding)."""

    def run(batches):
        for batch in batches:
            if len(batch):
                codes = encode(model.value, _matrix(batch.column("embedding")), query)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "least", "embedding")), packed], names=["cid", "least", "embedding", "code"])

    return run


def _pack(names: list[str], most: int):
    """A row for each ``most`` rows of a run of equal keys: ids, least ids, codes and vectors as binaries."""

    def run(batches):
        key, held, n = None, [], 0

        def close():
            parts = [np.concatenate([h[i] for h in held]).tobytes() for i in range(4)]
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), *(pa.array([p], pa.binary()) for p in parts)], names=[*names, "cid", "least", "code", "vectors"])

        for batch in batches:
            keys = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            edge = {0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), *range(0, len(keys), most), len(keys)}
            for a, b in itertools.pairwise(sorted(edge)):
                if held and (key != tuple(keys[a].tolist()) or n + b - a > most):
                    yield close()
                    held, n = [], 0
                key, n = tuple(keys[a].tolist()), n + b - a
                part = batch.slice(a, b - a)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64)
                held.append((part.column("cid").to_numpy(), part.column("least").to_numpy(), codes, _matrix(part.column("embedding"))))
        if held:
            yield close()

    return run


PACKED = "cid binary, least binary, code binary, vectors binary"
FOUND = "query long, cid long, least long, score double, distance int"


def _unpack(row: dict, side: str):
    cid, least = (np.frombuffer(row[f"{side}_{c}"], np.int64) for c in ("cid", "least"))
    return cid, least, np.frombuffer(row[f"{side}_code"], np.uint64).reshape(-1, 2), np.frombuffer(row[f"{side}_vectors"], np.float64).reshape(len(cid), -1)


def _search(radius: int, k: int, reach: int | None):
    """The best ``k`` of a block for each query of another: every code within the radius is met and ranked by the inner product.

    With a ``reach`` the blocks are a bucket of a substring and its probes: a code that an earlier substring finds as well is left to that one.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                qid, _, qcode, qvec = _unpack(row, "q")
                cid, least, code, vec = _unpack(row, "c")
                out = []
                for i in range(len(qid)):
                    differ = code ^ qcode[i]
                    distance = np.bitwise_count(differ).sum(axis=1)
                    near = distance <= radius
                    if reach is not None:
                        parts = np.bitwise_count(differ.view(np.uint16))
                        near &= np.argmax(parts <= reach, axis=1) == row["part"]
                    at = np.flatnonzero(near)
                    if not len(at):
                        continue
                    score = (vec[at] * qvec[i]).sum(axis=1)
                    best = np.lexsort((least[at], -score))[:k]
                    at = at[best]
                    out.append((np.full(len(at), qid[i]), cid[at], least[at], score[best], distance[at].astype(np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query", "cid", "least", "score", "distance"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _side(packs: DataFrame, side: str, *keys) -> DataFrame:
    return packs.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in ("cid", "least", "code", "vectors")])


def _packed(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_pack(list(keys), most), ", ".join(f"{c} long" for c in keys) + f", {PACKED}")


def _blocks(coded: DataFrame, ways: int, most: int) -> DataFrame:
    return cut(_packed(coded.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(ways))), most, "block"))


def scan(blocks: DataFrame, ways: int, queries: DataFrame, radius: int, k: int) -> DataFrame:
    """The ``k`` best within the radius where probes would touch most buckets: each block of queries meets each of the blocks of codes."""
    tiles = queries.select(F.col("block").alias("qb")).distinct().select("qb", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("cb"))
    pairs = tiles.join(_side(queries, "q", F.col("block").alias("qb")), "qb").join(_side(blocks, "c", F.col("block").alias("cb")), "cb")
    return _best(pairs.mapInArrow(_search(radius, k, None), FOUND), k)


def probe(items: DataFrame, queries: DataFrame, radius: int, k: int, most: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` best within the radius by the multi-index: codes within ``radius`` bits share a substring within radius // PARTS bits.

    Each substring of a code is a key of the index; a query asks for its own substrings and those a few bits away. Buckets
    are packed, and large ones cut into parts by a count, so that what comes out of a task are k rows a query and bucket.
    """
    reach = radius // PARTS
    masks = [sum(1 << b for b in bits) for n in range(reach + 1) for bits in itertools.combinations(range(SUB), n)]

    def substrings(flips):
        def run(batches):
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint16).reshape(len(batch), PARTS).astype(np.int64)
                every = (codes[:, :, None] ^ np.array(flips)).reshape(len(batch), -1)
                part = np.tile(np.repeat(np.arange(PARTS), len(flips)), len(batch))
                row = pa.array(np.repeat(np.arange(len(batch)), every.shape[1]))
                for at in range(0, len(row), 20_000):
                    some = batch.take(row.slice(at, 20_000))
                    yield pa.RecordBatch.from_arrays([pa.array(part[at : at + 20_000]), pa.array(every.ravel()[at : at + 20_000]), *some.columns], names=["part", "sub", *some.schema.names])

        return run

    schema = "part long, sub long, cid long, least long, embedding array<double>, code binary"
    index, asked = items.mapInArrow(substrings([0]), schema), queries.mapInArrow(substrings(masks), schema)

    def dealt(rows: DataFrame, most: int) -> DataFrame:
        heavy = rows.groupBy("part", "sub").count().where(F.col("count") > most).select("part", "sub", F.ceil(F.col("count") / most).cast("long").alias("ways"))
        rows = rows.join(few(cut(heavy)), ["part", "sub"], "left").withColumn("cell", F.pmod(F.xxhash64("cid"), F.coalesce("ways", F.lit(1)))).drop("ways")
        return _packed(rows, most, "part", "sub", "cell")

    pairs = _side(dealt(asked, min(most, QUERY_ROWS)), "q", "part", "sub").join(_side(dealt(index, most), "c", "part", "sub"), ["part", "sub"])
    return _best(pairs.mapInArrow(_search(radius, k, reach), FOUND), k)


def _radius(distances: list[int], share: float) -> int:
    """The smallest radius that holds the share of the distances."""
    ordered = sorted(distances)
    return ordered[max(0, math.ceil(share * len(ordered)) - 1)] if ordered else BITS


def _nearest(classes: DataFrame, dim: int, k: int, share: float, way: str | None) -> DataFrame:
    """``(query, cid, score)``: for each class with queries the ``k + 1`` best classes, itself included, among those of ``dim`` components."""
    spark, of = classes.sparkSession, classes.where(F.col("dim") == dim).select("cid", "least", F.col("embedding").cast("array<double>").alias("embedding"), "asks")
    top = F.array_max(F.transform("embedding", lambda v: F.abs(v)))
    norm = top * F.sqrt(F.aggregate(F.transform("embedding", lambda v: v / top), F.lit(0.0), lambda t, v: t + v * v))
    n, asking, largest = of.agg(F.count("*"), F.count_if("asks"), F.max(norm)).first()
    some = lambda rows, bound: rows.orderBy(F.xxhash64("embedding"), "cid").limit(bound)
    sample = some(of.select("cid", "embedding"), max(1, min(FITTED, FITTED_BYTES // (8 * dim)))).toArrow().column("embedding").combine_chunks()
    model = spark.sparkContext.broadcast(fit(_matrix(sample), largest))
    schema = "cid long, least long, embedding array<double>, code binary"
    items = cut(of.select("cid", "least", "embedding").mapInArrow(_coded(model, False), schema))
    queries = cut(of.where("asks").select("cid", "least", "embedding").mapInArrow(_coded(model, True), schema))
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
    asked_rows = min(rows, QUERY_ROWS)
    ways = max(1, math.ceil(n / rows))
    blocks = _blocks(items, ways, rows)

    def search(asked: DataFrame, count: int, radius: int) -> DataFrame:
        return scan(blocks, ways, _blocks(asked, max(1, math.ceil(count / asked_rows)), asked_rows), radius, k + 1)

    measured = search(cut(some(queries, MEASURED)), min(asking, MEASURED), BITS)
    radius = _radius([r["distance"] for r in measured.where("query <> cid").select("distance").collect()], share)
    probes = PARTS * sum(math.comb(SUB, i) for i in range(radius // PARTS + 1))
    probing = probes * PROBE_COST < n if way is None else way == "probe"
    found = cut(probe(items, queries, radius, k + 1, rows) if probing else search(queries, asking, radius))
    enough = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, n)).select("query")
    rest = cut(queries.join(enough, queries["cid"] == enough["query"], "left_anti"))
    left = rest.count()
    if left:  # too few within the radius: they meet all codes
        found = found.join(enough, "query", "left_semi").select("query", "cid", "score").union(search(rest, left, BITS).select("query", "cid", "score"))
    return found.select("query", "cid", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = K, share: float = RECALL, way: str | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each row of ``vectors(vec_id, embedding)`` whose id is divisible by ``every``.

    Nearness is the inner product in double precision; equal ones are ordered by vec_id. A vector's code are the signs of its learned
    rotations. A bounded sample of queries is compared with every vector first: the radius is the number of bits within which ``share``
    of their true neighbours lie, so it follows the whole table. All codes within it are met for every query, by probing the
    multi-index while that takes fewer steps than comparing all codes, else block by block; both give the same rows (``way`` sets one).
    Queries with fewer than ``k`` within the radius meet all vectors.

    Equal vectors are one class, coded and compared once, with its ``k + 1`` smallest ids. Vectors that are null, empty, zero or hold null
    or non-finite components take no part, nor rows with a null vec_id, and vectors of different lengths are not compared: each length is an index of its own.
    Rows that repeat a vec_id are vectors of their own; a query's own row is left out once. An empty table gives an empty result; other columns are not read.
    """
    good = vectors.select("vec_id", "embedding").where("vec_id is not null").where(_valid())
    own = Window.partitionBy("embedding").orderBy("vec_id")
    least = good.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = good.where(F.col("vec_id") % every == 0)
    classes = least.join(asked.groupBy("embedding").agg(F.count("*").alias("m")), "embedding", "left")
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")).withColumn("least", F.element_at("ids", 1)).withColumn("asks", F.col("m").isNotNull()))
    dims = [r["dim"] for r in classes.where("asks").select("dim").distinct().orderBy("dim").collect()]
    if not dims:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where(F.lit(False))
    found = None
    for dim in dims:
        one = _nearest(classes, dim, k, share, way)
        found = one if found is None else found.union(one)

    # From classes to rows: each class brings its first ids, of which the first k + 1 in all are kept.
    listed = found.join(classes.select("cid", "ids"), "cid").select("query", "cid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "cid"))).alias("best"))
    lists = cut(classes.where("asks").select("embedding", "m", F.col("cid").alias("query")).join(lists, "query"))
    pick = lambda rows: rows.select("vec_id", "query", "best")
    result = pick(asked.join(lists.where(F.col("m") <= HOT), "embedding"))
    hot = few(lists.where(F.col("m") > HOT))  # at most one for each HOT rows
    if not hot.isEmpty():
        result = result.union(pick(asked.join(hot, "embedding")))
    at = F.array_position(F.transform("best", lambda b: (b["vec_id"] == F.col("vec_id")) & (b["cid"] == F.col("query"))), True)
    others = F.slice(F.filter("best", lambda b, i: (i + 1) != F.col("at")), 1, k)
    result = result.withColumn("at", at).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("i", "b"))
    return result.select("query_id", (F.col("i") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
