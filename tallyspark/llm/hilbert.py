"""Shards cut from a Hilbert curve over quantised metadata, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Bits a dimension is quantised to.
BITS = 4
#: Rows that one run of a curve cell aims at; the cells are dealt into runs by a hash.
RUN_ROWS = 1_000_000
LEAST_RUNS = 64


def curve_table(spark: SparkSession, dims: int, bits: int = BITS) -> DataFrame:
    """``(cell, curve)``: the Hilbert index of every cell of the grid, 2 ** (dims * bits) rows.

    The transform undoes the rotations bit by bit, Gray-codes the axes and interleaves their bits.
    """
    high = [1 << b for b in range(bits - 1, -1, -1)]
    cell = F.col("id")
    axes = F.array(*[F.shiftright(cell, bits * (dims - 1 - i)).bitwiseAND((1 << bits) - 1).cast("int") for i in range(dims)])
    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in high[:-1] for i in range(dims)])

    def turn(x: Column, s: Column) -> Column:
        first, own, low = x[0], F.element_at(x, s["i"] + 1), s["q"] - 1
        is_set = own.bitwiseAND(s["q"]) != 0
        both = first.bitwiseXOR(own).bitwiseAND(low)
        head = F.when(is_set, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(both))
        return F.transform(x, lambda v, k: F.when(k == 0, head).when((k == s["i"]) & ~is_set, v.bitwiseXOR(both)).otherwise(v))

    turned = F.aggregate(steps, axes, turn) if bits > 1 else axes
    gray = F.transform("x", lambda v, k: F.aggregate(F.slice("x", F.lit(1), k + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))
    tail = F.aggregate(F.array(*map(F.lit, high[:-1])), F.lit(0), lambda t, q: F.when(F.element_at("x", -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)) if bits > 1 else F.lit(0)
    index = F.aggregate(
        F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in high for i in range(dims)]),
        F.lit(0).cast("long"),
        lambda n, s: n * 2 + (F.element_at("x", s["i"] + 1).bitwiseAND(s["q"]) != 0).cast("long"),
    )
    table = spark.range(1 << (dims * bits)).select(F.col("id").alias("cell"), turned.alias("x"))
    table = table.select("cell", gray.alias("x")).withColumn("t", tail)
    return table.select("cell", F.transform("x", lambda v: v.bitwiseXOR(F.col("t"))).alias("x")).select("cell", index.alias("curve"))


def metadata() -> list[Column]:
    """Language, source and size in bytes of a document, the dimensions of its cell; nulls count as empty."""
    return [F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), _size()]


def _size() -> Column:
    return (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")


def _crc() -> Column:
    return F.crc32(F.coalesce("text", F.lit("")).cast("binary"))


def bounds(rows: DataFrame, column: str, n: int, bits: int = BITS) -> list[tuple[int, object]]:
    """(cell, its least value) for the cells of a dimension beyond zero; they cut its ``n`` rows, in order, into like parts.

    A value lies in the cell that its first row falls in, so a common value leaves cells after it empty.

    Distinct values are counted and put in order by range, and running counts are taken within the
    ranges and over them, so no task sees all values; at most 2 ** bits - 1 of them reach the driver.
    """
    counts = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    counts = cut(counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("part")))
    before = (Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(*before)), F.lit(0))
    placed = counts.join(F.broadcast(parts), "part").select("v", (F.col("base") + within).alias("at"))  # a row for each range
    cells = placed.groupBy(F.expr(f"({1 << bits}L * at) div {max(n, 1)}L").alias("cell")).agg(F.min("v").alias("v")).where("cell > 0")
    return [(r["cell"], r["v"]) for r in cells.orderBy("cell").collect()]


def quantise(value: Column, least: list[tuple[int, object]]) -> Column:
    """The cell of a value: the last one whose least value it reaches. Order is kept, so a run of cells is a range of values."""
    return F.greatest(F.lit(0), F.lit(0), *[F.when(value >= F.lit(v), c).otherwise(0) for c, v in least])


class Layout:
    """Where each row of a table lies on the curve, and which of its rows begin a shard; all of it small and on the driver."""

    def __init__(self, docs: DataFrame, by: list[Column] | None = None):
        self.by = metadata() if by is None else by
        named = [c.alias(f"__d{i}") for i, c in enumerate(self.by)]
        self.rows = cut(docs.select("doc_id", _size().alias("size"), _crc().alias("text_crc32"), *named))
        self.n = self.rows.count()
        self.least = [bounds(self.rows, f"__d{i}", self.n) for i in range(len(self.by))]
        self.runs = max(LEAST_RUNS, math.ceil(self.n / RUN_ROWS))

    def keyed(self, rows: DataFrame, dims: list[Column], size: Column, crc: Column) -> DataFrame:
        """``rows`` with ``__key``: curve index, run, tie and what tells rows apart, in the order of the shards."""
        cell = F.lit(0).cast("long")
        for value, least in zip(dims, self.least):
            cell = cell * (1 << BITS) + quantise(value, least)
        table = F.broadcast(curve_table(rows.sparkSession, len(dims)))  # 2 ** (BITS * dims) rows, 4096 for three
        rows = rows.withColumn("__cell", cell).join(table.withColumnsRenamed({"cell": "__cell", "curve": "__curve"}), "__cell")
        tie = F.xxhash64("doc_id", crc, size)
        key = F.struct(F.col("__curve").alias("curve"), F.pmod(tie, F.lit(self.runs)).alias("run"), tie.alias("tie"), F.col("doc_id").alias("doc_id"), crc.alias("crc"), size.alias("size"))
        return rows.withColumn("__key", key).drop("__cell", "__curve")

    def placed(self, shards: int) -> DataFrame:
        """``(doc_id, size, text_crc32, shard, slot, __key)`` of every row."""
        dims = [F.col(f"__d{i}") for i in range(len(self.by))]
        rows = self.keyed(self.rows, dims, F.col("size"), F.col("text_crc32")).select("doc_id", "size", "text_crc32", "__key", F.col("__key.curve").alias("curve"), F.col("__key.run").alias("run"))
        counts = rows.groupBy("curve", "run").agg(F.count("*").alias("n"))
        before = (Window.unboundedPreceding, -1)
        cells = counts.groupBy("curve").agg(F.sum("n").alias("n"))
        cells = cells.select("curve", F.coalesce(F.sum("n").over(Window.orderBy("curve").rowsBetween(*before)), F.lit(0)).alias("cell_at"))
        within = Window.partitionBy("curve").orderBy("run").rowsBetween(*before)
        offsets = counts.select("curve", "run", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("run_at")).join(cells, "curve")
        order = Window.partitionBy("curve", "run").orderBy("__key")
        ranked = rows.join(offsets, ["curve", "run"]).withColumn("rank", F.col("cell_at") + F.col("run_at") + F.row_number().over(order) - 1)
        placed = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div {max(self.n, 1)} as int)"))
        slot = F.col("rank") - F.expr(f"(cast(shard as long) * {self.n} + {shards - 1}) div {shards}")
        return placed.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), "__key")


def assign(docs: DataFrame, shards: int = 8, by: list[Column] | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve)`` for every row of ``docs``.

    The law is ``rows``: the rows in curve order are cut into ``shards`` runs whose counts are at most
    one apart. Each dimension (language, source and size, or the columns ``by``) is quantised in its order at
    counted quantiles, so that a shard covers a compact region and min/max statistics of its files prune
    on every dimension. Ranks come from counts of (cell, run), where a run is a hash part of a cell, so a
    cell with a third of all rows is ranked by many tasks; no task sorts the table.

    A null text has no bytes: size 1 and CRC zero. A null language or source counts as the empty one.
    Equal texts are not held together, as that would break the law. Rows that are equal in every
    column read here are interchangeable. ``grown_shard`` is null under this law. An empty table gives
    an empty result; other columns are not read.
    """
    placed = Layout(docs, by).placed(shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("__key.curve").alias("curve"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, by: list[Column] | None = None) -> str:
    """Write ``docs`` as one Parquet folder for each shard, its rows in curve order; returns the name of the shard column.

    The first row of each shard (the only rows that reach the driver) tells by comparison where a row
    goes, so texts are moved once, to where they are written. The column is named ``shard``, with
    underscores added while ``docs`` has a column of that name. Of rows that are equal in doc_id, size
    and CRC all go to one shard. An empty table writes an empty table.
    """
    layout = Layout(docs, by)
    name = "shard"
    while name in docs.columns:
        name += "_"
    firsts = layout.placed(shards).where("slot = 0 and shard > 0").select("shard", "__key").orderBy("shard").collect()
    rows = layout.keyed(docs, layout.by, _size(), _crc())
    types = rows.schema["__key"].dataType
    at = F.lit(0)
    for first in firsts:
        k = first["__key"]
        least = F.struct(*[F.lit(k[f.name]).cast(f.dataType).alias(f.name) for f in types.fields])
        at = at + (F.col("__key") >= least).cast("int")
    rows = rows.withColumn(name, at)
    rows.repartitionByRange(name, "__key").sortWithinPartitions(name, "__key").drop("__key").write.partitionBy(name).parquet(path)
    return name
