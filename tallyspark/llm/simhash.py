"""SimHash fingerprints linked through a sharded forest of vantage-point trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, map_batches, slices
from .components import connected_components, local_labels

SHINGLE = 4
RADIUS = 4
#: Trees of the forest; each takes a part of the bits.
BLOCKS = 3
#: Fingerprints that are compared all with all at the end of a branch.
LEAF = 512
#: Comparisons that a split may leave, as a share of those without it.
SPLIT = 0.8
#: Fingerprints aimed at in a shard, shards of a tree (bounded), and those of the sample for each.
SHARD_ROWS, MOST_LEAVES, LEAF_SAMPLE = 5_000, 1 << 14, 64
#: Rows aimed at in a task, which takes several shards.
TASK_ROWS = 50_000
#: Rows of one shard that one task compares; larger shards are cut into tiles.
TILE_ROWS = 100_000
#: Rows of one fingerprint or of one doc_id beyond which what is known of it is broadcast to them instead of shuffled with them.
HOT = 100_000
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of the word shingles of a text, repeats included.

    A-Z are lower-cased and words are runs without ASCII white space. Fewer than ``width`` words give
    one shingle of all of them, no words give none.
    """
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length) - 1
    start = (end - length + 1)[: len(words) - width + 1].tolist()
    return [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(start, end[width - 1 :].tolist())]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of ``counts`` hashes: bits set in over half of them.

    Eight bit positions are counted at once in the bytes of a 64-bit sum, in pieces of at most 255.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    pieces = -(-n // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(np.cumsum(n) - n, pieces) + 255 * within
    first = np.searchsorted(owner, np.arange(len(full)))
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every whole text; null and wordless texts get fingerprint zero."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes = [shingle_hashes(t or "", width) for t in part.column("text").to_pylist()]
                counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
                flat = np.fromiter((h for one in hashes for h in one), np.uint64, int(counts.sum()))
                bits = majority_bits(flat, counts).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits)], names=["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _nearest_half(sample: np.ndarray, masks: list[tuple[np.uint64, int]], rng: np.random.Generator):
    """(vantage point, median, mask, reach) that splits a sample best, or None if no split makes less work.

    A good split is even and has few fingerprints within reach of its boundary, as these go to both sides;
    comparing all with all in both must take well under the comparisons of the whole.
    """
    best = None
    for v in rng.choice(sample, 6):
        for mask, reach in masks:
            d = np.bitwise_count((sample ^ v) & mask).astype(np.int64)
            median = int(np.median(d))
            if median >= d.max():
                median = int(d.max()) - 1
            work = float((d <= median).mean()) ** 2 + float((d + reach > median).mean()) ** 2
            if median >= 0 and work < SPLIT and (best is None or work < best[0]):
                best = (work, v, median, mask, reach)
    return best and best[1:]


class Forest:
    """One vantage-point tree for each block of bits; each node has a vantage point of its own.

    Two fingerprints that differ in at most ``radius`` bits differ in at most ``radius // blocks``
    bits of some block. Each block has a tree over the Hamming distance on its bits, whose leaves are
    shards. By the triangle inequality a ball of radius r about a fingerprint reaches the other side of
    a node only if its distance from the vantage point lies within r of the median; only then is that
    branch asked too.
    """

    def __init__(self, sample: np.ndarray, leaves: int, radius: int = RADIUS, blocks: int = BLOCKS):
        self.reach = radius // blocks
        self.trees = []
        rng, low = np.random.default_rng(7), 0
        for b in range(blocks):
            width = 64 // blocks + (b < 64 % blocks)
            mask = np.uint64(((1 << width) - 1) << low)
            low += width
            self.trees.append((mask, self._tree(sample, max(16, len(sample) // leaves), mask, rng)))

    def _tree(self, sample: np.ndarray, least: int, mask: np.uint64, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        point, median, inner, outer = [np.uint64(0)], [0], [-1], [-1]
        todo = [(0, sample)]
        while todo:
            node, here = todo.pop()
            split = _nearest_half(here, [(mask, self.reach)], rng) if len(here) > least else None
            if split is None:
                continue
            point[node], median[node], inner[node], outer[node] = split[0], split[1], len(point), len(point) + 1
            inside = np.bitwise_count((here ^ split[0]) & mask).astype(np.int64) <= split[1]
            todo += [(len(point), here[inside]), (len(point) + 1, here[~inside])]
            for x, empty in ((point, np.uint64(0)), (median, 0), (inner, -1), (outer, -1)):
                x += [empty, empty]
        return np.array(point, np.uint64), np.array(median), np.array(inner), np.array(outer)

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, index of the fingerprint, whether it lives there) for every shard to ask.

        Of two fingerprints in different shards only the one inside at their first differing node asks.
        """
        shards, rows, homes = [], [], []
        for b, (mask, (point, median, inner, outer)) in enumerate(self.trees):
            row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
            while len(row):
                leaf = inner[node] < 0
                shards.append(node[leaf] + (b << 40))
                rows.append(row[leaf])
                homes.append(home[leaf])
                row, node, home = row[~leaf], node[~leaf], home[~leaf]
                d = np.bitwise_count((fps[row] ^ point[node]) & mask).astype(np.int64)
                inside, cross = _sides(d, median[node], self.reach, home)
                node = np.concatenate([np.where(inside, inner[node], outer[node]), np.where(inside, outer[node], inner[node])[cross]])
                row, home = np.concatenate([row, row[cross]]), np.concatenate([home, np.zeros(int(cross.sum()), bool)])
        return np.concatenate(shards), np.concatenate(rows), np.concatenate(homes)


def _sides(d: np.ndarray, median, reach: int, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inside, asks the other side too): those that live outside are asked by those inside and need not ask."""
    inside = d <= median
    return inside, np.where(inside, d + reach > median, (d - reach <= median) & ~home)


def _leaf_links(fps: np.ndarray, home: np.ndarray, radius: int, masks: list[tuple[np.uint64, int]], leaf: int = LEAF, block: int = 1 << 22):
    """Links that span the local components of one shard, without listing all pairs.

    The tree goes on inside the shard, on the block's bits or on all of them, whichever splits better, until
    a branch is small or its fingerprints are all near each other; then those that live there meet all in it.
    """
    label = np.arange(len(fps))
    rng = np.random.default_rng(len(fps))
    todo = [(np.arange(len(fps)), home)]
    while todo:
        at, lives = todo.pop()
        if not lives.any() or len(at) < 2:
            continue
        here = fps[at]
        split = _nearest_half(here if len(here) <= 512 else rng.choice(here, 512, replace=False), masks, rng) if len(at) > leaf else None
        if split is not None:
            v, median, mask, reach = split
            inside, cross = _sides(np.bitwise_count((here ^ v) & mask).astype(np.int64), median, reach, lives)
            sides = [(np.concatenate([at[s], at[cross & ~s]]), np.concatenate([lives[s], np.zeros(int((cross & ~s).sum()), bool)])) for s in (inside, ~inside)]
            if sum(len(s) ** 2 for s, _ in sides) < SPLIT * len(at) ** 2:
                todo += sides
                continue
        members = np.flatnonzero(lives)
        step = max(1, block // len(members))
        for low in range(0, len(at), step):
            near = np.bitwise_count(here[low : low + step, None] ^ here[members][None, :]) <= radius
            i, j = np.nonzero(near)
            i, j = at[i + low], at[members[j]]
            apart = label[i] != label[j]
            if apart.any():
                star = np.flatnonzero(label != np.arange(len(fps)))
                label = local_labels(len(fps), np.concatenate([i[apart], star]), np.concatenate([j[apart], label[star]]))
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return (fps[linked], fps[label[linked]]) if len(linked) else None


def _group_links(radius: int, masks: list[np.uint64], reach: int):
    def run(batches):
        held: list[tuple] = []

        def close():
            fp = np.concatenate([x[0] for x in held]).view(np.uint64)
            ways = [(masks[int(key[0]) >> 40], reach), (np.uint64((1 << 64) - 1), radius)]
            return _leaf_links(fp, np.concatenate([x[1] for x in held]), radius, ways)

        key = None
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            tile = batch.column("tile").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            home = batch.column("home").to_numpy(zero_copy_only=False).astype(bool)
            edge = np.flatnonzero((np.diff(shard) != 0) | (np.diff(tile) != 0)) + 1
            links = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(shard)]):
                if a == b:
                    continue
                if key is not None and key != (shard[a], tile[a]):
                    links.append(close())
                    held.clear()
                key = (shard[a], tile[a])
                held.append((fp[a:b], home[a:b]))
            yield from _as_batches(links)
        if held:
            yield from _as_batches([close()])

    return run


def _as_batches(links):
    links = [x for x in links if x is not None]
    if links:
        a = np.concatenate([x[0] for x in links]).view(np.int64)
        b = np.concatenate([x[1] for x in links]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``radius`` bits.

    Exact: every pair within the radius is compared in some shard; what is returned spans the same
    components. The trees are built on the driver from a bounded sample, for shards of about ``shard_rows``,
    and go on in the tasks. A shard over ``tile_rows``, as only fingerprints that lie close together can make,
    is cut into parts, and each pair of parts is a task of its own; no task holds more than two parts.
    """
    leaves = 1 << max(0, math.ceil(math.log2(max(1, fps.count()) / shard_rows)))
    leaves = min(leaves, MOST_LEAVES)
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(LEAF_SAMPLE * leaves).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    forest = fps.sparkSession.sparkContext.broadcast(Forest(sample, leaves, radius))

    def run(batches):
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(every), 4096):
                part = every[at : at + 4096]
                shard, row, home = forest.value.route(part)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part[row].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    routed = fps.mapInArrow(run, "shard long, fp long, home boolean")
    counts = cut(routed.groupBy("shard").count())
    tasks = max(1, math.ceil((counts.agg(F.sum("count")).first()[0] or 0) / TASK_ROWS))
    heavy = counts.where(F.col("count") > tile_rows).select("shard", F.ceil(F.col("count") / tile_rows).cast("int").alias("ways"))
    if heavy.isEmpty():
        dealt = routed.withColumn("tile", F.lit(0))
    else:
        ways = F.coalesce("ways", F.lit(1))
        own = F.pmod(F.xxhash64("fp"), ways).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), ways - 1), lambda k: F.least(own, k) * ways + F.greatest(own, k))
        dealt = routed.join(F.broadcast(heavy), "shard", "left").select("shard", "fp", "home", F.explode(pairs).alias("tile"))  # a row for each shard
    dealt = dealt.repartition(tasks, "shard", "tile").sortWithinPartitions("shard", "tile")
    masks, reach = [mask for mask, _ in forest.value.trees], forest.value.reach
    return dealt.mapInArrow(_group_links(radius, masks, reach), "a long, b long")


def components(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` bits. Equal
    fingerprints are one class, compared once. Texts that are null or without words have fingerprint
    zero and are linked like any other. Rows that repeat a doc_id all stay and share what any of them
    links to; rows with a null doc_id keep null in ``component_id`` only if nothing else is reachable.
    An empty table gives an empty result. Other columns are not read.
    """
    fp = cut(fingerprints(docs, width))
    classes = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")))
    links = cut(near_links(classes.select("fp"), radius))
    same_id = cut(fp.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("m")).where("a <> b").select("doc_id", "a", "m"))
    repeats = _join_hot(fp, same_id, "doc_id").select("a", F.col("fp").alias("b"))
    roots = connected_components(links.union(repeats))
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "m")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = cut(placed.select("fp", "root", "m").join(least, "root").select("fp", "component_id", "m"))
    return _join_hot(fp, by_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _join_hot(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``facts``, one for each key, where ``m`` is the number of rows of the key: keys of over ``HOT`` rows stay where they are."""
    joined = rows.join(facts.where(F.col("m") <= HOT), key)
    hot = few(facts.where(F.col("m") > HOT))  # at most one for each HOT rows
    return joined if hot.isEmpty() else joined.union(rows.join(hot, key))
