"""A CSV source that refuses what Spark's own reader lets pass: stray quotes, other headers, bad UTF-8."""

from __future__ import annotations

import csv
import io

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes and rows of a file (fixed values).
MOST_BYTES, MOST_ROWS = 1 << 20, 2_000


class StrictCsv(DataSource):
    """``spark.read.format("strict_csv").option("path", …).option("columns", "a,b").load()``.

    The path is a file or a folder of ``.csv`` files, in any store that Arrow knows. Each file must have
    exactly the named columns in order, strict quoting, as many fields in every row, and at most
    ``max_bytes`` and ``max_rows``. All columns are text; nothing is trimmed or guessed.
    """

    @classmethod
    def name(cls) -> str:
        return "strict_csv"

    def columns(self) -> list[str]:
        return next(csv.reader([self.options["columns"]]))

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self.columns()])

    def reader(self, schema: StructType) -> StrictReader:
        return StrictReader(self.columns(), self.options)


class File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class StrictReader(DataSourceReader):
    """One partition a file; files are bounded, so a task holds one whole."""

    def __init__(self, columns: list[str], options):
        self.names, self.uri = columns, options["path"]
        self.most_bytes, self.most_rows = int(options.get("max_bytes", MOST_BYTES)), int(options.get("max_rows", MOST_ROWS))

    def partitions(self) -> list[InputPartition]:
        store, path = _open(self.uri)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [File(self.uri)]
        found = store.get_file_info(fs.FileSelector(path))
        return [File(f"{self.uri.rstrip('/')}/{f.base_name}") for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".csv")]

    def read(self, partition: File):
        store, path = _open(partition.uri)
        with store.open_input_file(path) as f:
            if f.size() > self.most_bytes:
                raise ValueError(f"{partition.uri}: over {self.most_bytes} bytes")
            text = f.read().decode("utf-8", errors="strict")
        rows = csv.reader(io.StringIO(text, newline=""), strict=True)
        if next(rows, None) != self.names:
            raise ValueError(f"{partition.uri}: other columns")
        for n, fields in enumerate(rows, 1):
            if len(fields) != len(self.names):
                raise ValueError(f"{partition.uri}: row {n} has {len(fields)} fields")
            if n > self.most_rows:
                raise ValueError(f"{partition.uri}: over {self.most_rows} rows")
            yield tuple(fields)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StrictCsv)
