"""Outputs that never overwrite, and the manifest of what was released."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import Refused
from .pinned import MOST_FILES, files, relative

#: Folders that results must not be written to (fixed values).
RESERVED = ("public", "dist", "data", "fixtures", "baseline")


def check_target(path: str, inputs: Sequence[str] = ()) -> str:
    """SNK2: a target outside the published folders and the inputs themselves."""
    parts = [p.lower() for p in path.split("://")[-1].split("/") if p]
    if ".." in parts or any(p in RESERVED for p in parts):
        raise ValueError(f"reserved target {path!r}")
    for i in inputs:
        if f"{path.rstrip('/')}/".startswith(f"{i.rstrip('/')}/"):
            raise ValueError(f"target {path!r} lies in an input")
    return path


def write_new(df: DataFrame, path: str, inputs: Sequence[str] = (), format: str = "json") -> None:
    """SNK1: write to a folder that is not there yet; an existing one is an error."""
    df.write.mode("errorifexists").format(format).save(check_target(path, inputs))


def release(spark: SparkSession, root: str, allowed: DataFrame) -> DataFrame:
    """SNK3: ``(path, bytes, sha)`` of the released files; a file that is not allowed, or an allowed one that is missing, is an error.

    ``allowed``: path, relative to the root. Only the manifest is built here; writing it is :func:`write_new`'s.
    """
    found = files(spark, root).select(relative(root).alias("path"), "bytes", "sha")
    odd = found.join(allowed, "path", "left_anti").union(allowed.join(found, "path", "left_anti").select("path", F.lit(None).cast("long"), F.lit(None).cast("string"))).limit(1).collect()
    if odd:
        raise ValueError(f"release differs at {odd[0].path}")
    return found.orderBy("path")


def identity(manifest: DataFrame) -> DataFrame:
    """SNK6: one digest for a set of files, whatever order they are listed in; a release has at most ``MOST_FILES``, more are :class:`Refused`."""
    if manifest.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise Refused(f"more than {MOST_FILES} files")
    pairs = F.sort_array(F.collect_list(F.concat_ws(":", "path", "sha")))
    return manifest.agg(F.sha2(F.array_join(pairs, "\n"), 256).alias("sha"))


def evidence_export(bundle: DataFrame, matching: DataFrame, filters: dict[str, str], scope: str) -> DataFrame:
    """SNK4: header rows ``(bundle, review)`` with the filters, the scope and the ids that match, for one JSON file a bundle.

    ``bundle``: bundle, review. ``matching``: bundle, id. Ids are listed in order; an export is as large as what it lists.
    """
    ids = matching.groupBy("bundle").agg(F.sort_array(F.collect_list("id")).alias("matchingRecordIds"))
    chosen = F.create_map(*[F.lit(x) for kv in sorted(filters.items()) for x in kv]) if filters else F.create_map().cast("map<string,string>")
    listed = F.coalesce("matchingRecordIds", F.array().cast("array<string>"))
    return bundle.join(ids, "bundle", "left").select("bundle", "review", chosen.alias("filters"), F.lit(scope).alias("scope"), listed.alias("matchingRecordIds"))
