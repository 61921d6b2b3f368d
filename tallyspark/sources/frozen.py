"""Admitted snapshots: tables written once, below the folder that all executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below the one named in ``spark.checkpoint.dir``.

    In local mode, as in tests, a temporary folder is made if that setting is absent; on a cluster that is
    an error, since executors would write to disks of their own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="tally-"))
        base = _own_dir[0]
    return f"{base.rstrip('/')}/plans-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """M3: ``df`` as it is now. What it was read from may change afterwards; what is returned does not."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Snapshots:
    """SRC6: frozen snapshots by what they were admitted under; each is loaded once, and a refused one not at all."""

    def __init__(self):
        self._held: dict[Hashable, DataFrame] = {}

    def get(self, pin: Hashable, load: Callable[[], DataFrame]) -> DataFrame:
        if pin not in self._held:
            self._held[pin] = freeze(load())
        return self._held[pin]
