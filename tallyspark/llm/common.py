"""Shared plumbing: durable intermediate tables, text batches and bounded caches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []


def base_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share.

    In local mode, as in tests, a temporary folder is made if that setting is absent; on a cluster that is an error,
    since executors would write to disks of their own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tally-"))
    return _own_dir[0]


def shared_dir(spark: SparkSession) -> str:
    """A new folder for this application below :func:`base_dir`."""
    return f"{base_dir(spark)}/tally-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def remove_intermediates(spark: SparkSession) -> None:
    """Delete all that :func:`shared_dir` has named in this application; results that were not written elsewhere go with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base_dir(spark)}/tally-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table of ids is broadcast; a larger one is joined by shuffling both sides.
BROADCAST_ROWS = 200_000


def few(ids: DataFrame, bound: int | None = None) -> DataFrame:
    """A written table of ids, marked for broadcast if it has been counted to be within the bound.

    Beyond it both sides are shuffled and the ids are hashed, so that the texts they meet are not sorted.
    """
    return F.broadcast(ids) if ids.count() <= (BROADCAST_ROWS if bound is None else bound) else ids.hint("shuffle_hash")


#: Bytes of an Arrow batch. Texts are long, and by default ten thousand of them travel at once.
BATCH_BYTES = 8_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with small batches, which bound what the JVM and a Python worker hold of texts at once.

    The session's limit is set unless the application was started with one of its own.
    """
    spark = df.sparkSession
    if spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def running_sum(rows: DataFrame, order: str, group: Column, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` in the rows before, in the order of a column of distinct values.

    ``group`` is a function of ``order`` that does not fall as it rises; sums are taken within the groups and
    over them, so that no task orders all rows.
    """
    until = (Window.unboundedPreceding, -1)
    parts = rows.withColumn("__group", group).withColumn("__value", value)
    sums = parts.groupBy("__group").agg(F.sum("__value").alias("n"))
    sums = sums.select("__group", F.coalesce(F.sum("n").over(Window.orderBy("__group").rowsBetween(*until)), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum("__value").over(Window.partitionBy("__group").orderBy(order).rowsBetween(*until)), F.lit(0))
    return parts.join(sums, "__group").withColumn(name, F.col("__base") + within).drop("__group", "__value", "__base")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = 4_000_000):
    """Cut a record batch into runs of rows of about ``budget`` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > budget:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


class Recent(dict):
    """A bounded memory in two generations: a full one becomes the old one, from which what is met again comes back."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that are not remembered; all others can be looked up until the next call."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        lacking = keys.difference(self)
        back = lacking.intersection(self.old)
        for k in back:
            self[k] = self.old[k]
        return list(lacking.difference(back))
