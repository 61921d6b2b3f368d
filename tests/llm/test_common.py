"""Intermediate tables: where they lie, and that they can be removed."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common


def test_intermediates_lie_in_the_shared_folder_and_can_be_removed(spark):
    folder = Path(common.shared_dir(spark).removeprefix("file://")).parent
    df = common.cut(spark.range(10))
    assert df.count() == 10 and folder.exists()
    common.remove_intermediates(spark)
    assert not folder.exists() and common.cut(spark.range(3)).count() == 3


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda k: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.base_dir(cluster)


def test_running_sums(spark):
    rows = spark.createDataFrame([(f"part-{i:06d}", i % 7) for i in (5, 1, 250, 99, 100, 101, 999_999)], "file string, n long")
    got = common.running_sum(rows, "file", F.substring("file", 1, 9), F.col("n"), "before").orderBy("file").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.n
    assert common.running_sum(rows.limit(0), "file", F.substring("file", 1, 9), F.col("n"), "before").count() == 0
