"""Two snapshots of a table compared by key, and the versions that several copies hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """J16, SET1: one row a key with before, after and change: added, removed, changed or same.

    Keys are compared null-safely; so are values, as a value that becomes unknown is a change.
    """
    a = old.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col(value).alias("before"), F.lit(True).alias("__old"))
    b = new.select(*[F.col(k).alias(f"__n_{k}") for k in keys], F.col(value).alias("after"), F.lit(True).alias("__new"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"__o_{k}").eqNullSafe(F.col(f"__n_{k}"))
    both = a.join(b, on, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return both.select(*[F.coalesce(f"__o_{k}", f"__n_{k}").alias(k) for k in keys], "before", "after", change.alias("change"))


def coverage(changed: DataFrame, by: str, keys: Sequence[str]) -> DataFrame:
    """A27, SET2, SRT4: counts and sorted keys of what was added, removed and changed, for the union of groups.

    Key lists hold only the differences, as text; unchanged keys are only counted.
    """
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(F.col("change") == c, key))), ",")
    return changed.groupBy(by).agg(
        F.count_if(F.col("change") != "added").alias("n_old"), F.count_if(F.col("change") != "removed").alias("n_new"),
        *[listed(c).alias(f"{c}_keys") for c in ("added", "removed", "changed")],
    )


def change_counts(changed: DataFrame, by: str) -> DataFrame:
    """The counts of :func:`coverage` alone, for groups of any size."""
    return changed.groupBy(by).agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("added", "removed", "changed", "same")])


def conflicts(artifacts: DataFrame) -> DataFrame:
    """Paths for which snapshots hold different kinds or bytes; every version is kept, in order of snapshots.

    ``artifacts``: snapshot, path, kind, sha. Paths with one version are dropped before versions are collected.
    """
    several = artifacts.groupBy("path").agg(F.count_distinct(F.struct("kind", "sha")).alias("n_versions")).where("n_versions > 1")
    versions = artifacts.join(several, "path").groupBy("path", "n_versions")
    return versions.agg(F.sort_array(F.collect_list(F.struct("snapshot", "kind", "sha"))).alias("versions"))


def versions(artifacts: DataFrame) -> DataFrame:
    """A29 for groups of any size: the versions of :func:`conflicts` as rows, copies within a snapshot counted in ``n_copies``."""
    each = artifacts.groupBy("path", "snapshot", "kind", "sha").agg(F.count("*").alias("n_copies"))
    several = each.groupBy("path").agg(F.count_distinct(F.struct("kind", "sha")).alias("n_versions")).where("n_versions > 1")
    return each.join(several, "path")


def cadence_floor(clocks: DataFrame, column: str = "at", days: int = 7) -> DataFrame:
    """The latest known time plus a week, before which nothing may be tried; null if no time is known."""
    return clocks.agg((F.max(column) + F.expr(f"interval {days} days")).alias("floor"))


def totals(artifacts: DataFrame) -> DataFrame:
    """Files, folders and bytes by snapshot."""
    return artifacts.groupBy("snapshot").agg(F.count_if(F.col("kind") == "file").alias("n_files"), F.count_if(F.col("kind") == "directory").alias("n_folders"), F.sum("bytes").alias("n_bytes"))
