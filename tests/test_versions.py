"""Conflicting versions as rows: no array holds a group of copies."""

from tallyspark import plans
from tallyspark.operators import diff

SF = "/root/testdata/sf0.001"


def test_copies_are_counted_and_not_collected(spark):
    rows = spark.createDataFrame([("s1", "p", "file", "a"), *[("s2", "p", "file", "b")] * 50, ("s1", "q", "file", "a"), ("s2", "q", "file", "a")], "snapshot string, path string, kind string, sha string")
    assert sorted((r.path, r.snapshot, r.sha, r.n_copies, r.n_versions) for r in diff.versions(rows).collect()) == [("p", "s1", "a", 1, 2), ("p", "s2", "b", 50, 2)]
    text = plans.QUERIES["version_conflicts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text
