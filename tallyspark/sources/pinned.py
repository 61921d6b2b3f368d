"""Files that are let in only if their bytes are the reviewed ones: hashes come before parsing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.hashing import has_keys, is_digest
from ..operators.gates import Refused, Rule, admit, agg, key, row
from .frozen import freeze

#: Bounds (fixed values): bytes of a file by default and at most, of an inventoried file and snapshot; shards and their rows.
DEFAULT_BYTES, MOST_BYTES, FILE_BYTES, SNAPSHOT_BYTES = 500_000, 2_000_000, 8 << 20, 64 << 20
MOST_FILES, MOST_ENTRIES, MOST_DEPTH, MOST_SHARDS, MOST_SHARD_ROWS = 4_096, 8_192, 4, 100, 1_000
#: Levels that a chain of digests has at most.
MOST_LEVELS = 16

#: Fields of a review receipt by kind (fixed values).
RECEIPT = {
    "foundation": ("status", "reviewer", "reviewedOn", "evidenceId", "scope", "limitations", "bundleSha256", "checks"),
    "tender": ("status", "reviewer", "reviewedOn", "evidenceId", "scope", "limitations", "indexSha256", "captureManifestSha256", "orderedSourceDigest", "fieldNames"),
    "budget": ("status", "reviewer", "reviewedOn", "evidenceId", "limitations", "bundleSha256", "sourcePdfSha256", "checks"),
    "audit": ("status", "reviewer", "reviewedOn", "evidenceId", "scope", "limitations", "bundleSha256", "sourceSha256", "checks"),
    "municipal": ("status", "reviewer", "reviewedOn", "evidenceId", "scope", "limitations", "bundleSha256", "captureManifestSha256", "metadataSha256", "checks"),
    "supplier": ("status", "reviewer", "reviewedOn", "evidenceId", "scope", "limitations", "bundleSha256", "captureManifestSha256", "orderedSourceDigest", "proposalSha256", "checks"),
}
RECEIPT["reporting"] = RECEIPT["foundation"]


def check_path(path: str) -> str:
    """SRC12: a relative path in the one form that names it, which does not leave its root: no empty part, no ``.`` or ``..``.

    Spark's readers follow links; a file that a link leads to has to have the pinned digest like any other.
    """
    if any(part in ("", ".", "..") for part in path.split("/")) or "\\" in path or "\0" in path:
        raise ValueError(f"path {path!r}")
    return path


def files(spark: SparkSession, root: str | list[str], glob: str = "*", most: int = MOST_BYTES, recursive: bool = True) -> DataFrame:
    """SRC8: ``(path, bytes, sha, body)`` of the files below a folder; a body over the bound is null, its size and name stay.

    The bound is a filter on the length that the source applies to its listing, so larger files are not read.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    within = read.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha"), F.col("content").alias("body"))
    over = read.where(F.col("length") > most).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha"), F.lit(None).cast("binary").alias("body"))
    return within.union(over)


def relative(root: str) -> Column:
    """The ``path`` of a file below a folder, relative to it."""
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    return F.regexp_replace(F.expr("substring_index(path, ':', -1)"), r"\A/*" + "\\Q" + base + "\\E/?", "")


def verified(found: DataFrame, pins: DataFrame, most: int = DEFAULT_BYTES, version: str | None = None) -> DataFrame:
    """SRC1, SRC5, SRC9, SRC10: ``(name, text)`` of pinned files, or :class:`Refused` if any differs.

    ``pins``: name, sha, bytes (null: unknown). A file must be there, within the bound, of the pinned
    length and digest, and valid UTF-8 without repeated keys; with ``version`` its schemaVersion must be that.
    Files are read once, into a frozen copy that is both judged and handed out, so a file that changes
    after its admission changes nothing.
    """
    if not 1 <= most <= MOST_BYTES:
        raise ValueError(f"bound {most}")
    named = found.select(F.substring_index("path", "/", -1).alias("name"), F.col("bytes").alias("found_bytes"), F.col("body"))
    joined = freeze(pins.join(named, "name", "left")).withColumn("found_sha", F.sha2("body", 256))
    joined = joined.withColumn("text", F.try_validate_utf8("body").cast("string"))
    rules = [
        row("bound", F.col("found_bytes") <= most),
        row("length", F.col("bytes").isNull() | (F.col("bytes") == F.col("found_bytes"))),
        row("digest", is_digest(F.col("sha")) & (F.col("sha") == F.col("found_sha"))),
        row("utf8", F.col("text").isNotNull()),
        row("json", F.try_parse_json("text").isNotNull()),
        key("one_file", "name"),
    ]
    if version is not None:
        rules.append(row("version", F.get_json_object("text", "$.schemaVersion") == version))
    return admit(joined, rules, "name").select("name", "text")


def manifest_rules(pattern: str, most: int = MOST_SHARDS) -> list[Rule]:
    """SRC2: a manifest's ``(path, bytes, records, sha, record_count)`` rows: at most so many, bounded, unique, and adding up."""
    return [
        row("path", F.col("path").rlike(pattern)), row("bytes", F.col("bytes").between(1, DEFAULT_BYTES)), row("records", F.col("records").between(1, MOST_SHARD_ROWS)), row("sha", is_digest(F.col("sha"))),
        key("path_unique", "path"), agg("shards", F.count("*") <= most), agg("sum", F.sum("records") == F.max("record_count")),
    ]


def load_shards(spark: SparkSession, root: str, manifest: DataFrame, schema: StructType | str, pattern: str = r"\A[a-z]+-[0-9]{3}\.json\z", keys: Sequence[str] = ("schemaVersion", "records"), id: str = "id", glob: str = "*.json", version: str | None = None, most: int = MOST_SHARDS) -> DataFrame:
    """SRC3, SRC4, SRC6: rows of all shards of a manifest: all of them, or :class:`Refused`.

    Shards are read and hashed by Spark's own tasks. Each must hold as many records as it says, with
    exactly the declared keys, and identities must be unique over all; nothing is handed out before. Rows come
    from the frozen bytes that were hashed, and the manifest is frozen before it is judged.
    """
    manifest = admit(freeze(manifest), manifest_rules(pattern, most), "path")
    text = verified(files(spark, root, glob, DEFAULT_BYTES), manifest.select(F.col("path").alias("name"), "sha", "bytes"), version=version)
    return _records(text.join(manifest.select(F.col("path").alias("name"), "records"), "name"), schema, keys, id)


def _records(shards: DataFrame, schema: StructType | str, keys: Sequence[str], id: str) -> DataFrame:
    """The rows of admitted ``shards(name, text, records)``, if each holds what it says and identities are unique over all."""
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = shards.withColumn("items", F.from_json(F.get_json_object("text", "$.records"), "array<string>"))
    admit(raw, [row("shape", has_keys(F.col("text"), *keys)), row("count", F.size("items") == F.col("records"))], "name")
    items = raw.select(F.explode("items").alias("item"))
    names = [f.name for f in shape]
    rows = items.select(has_keys(F.col("item"), *names).alias("__closed"), F.from_json("item", shape).alias("r")).select("__closed", "r.*")
    return admit(rows, [row("closed", F.col("__closed")), row(f"{id}_present", F.length(F.col(id)) > 0), key(f"{id}_unique", id)], id).drop("__closed")


#: The name of a file: the last part of its path.
NAME = "substring_index(path, '/', -1)"
#: Files up to which a level's are opened one by one; beyond it the folder is read.
FEW_FILES = 1_000


def _those(spark: SparkSession, root: str, glob: str, most: int, name: str, pins: DataFrame) -> DataFrame:
    """The files that ``pins`` name: found in a listing, so that the others are not opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path")
    paths = [r["path"] for r in listed.withColumn("name", F.expr(name)).join(pins.select("name"), "name", "left_semi").select("path").limit(FEW_FILES + 1).collect()]
    return files(spark, paths if 0 < len(paths) <= FEW_FILES else root, glob, most)


def chain(spark: SparkSession, root: str, first: DataFrame, links: Column, rules: Callable[[int], Sequence[Rule]] = lambda level: (), most_levels: int = MOST_LEVELS, most: int = DEFAULT_BYTES, glob: str = "*.json", name: str = NAME) -> DataFrame:
    """SRC5: ``(level, name, sha, text, records)`` of all files that a chain of digests leads to, or :class:`Refused`.

    ``first``: name, sha, bytes of the files of level 0; a null sha is allowed there alone, for what is trusted by its place, such as
    a review receipt. ``links``: an array of (name, sha, bytes, records) that the text of a file names; what the files of a level name is the next level.
    Each level is read once, frozen and judged, by its pins and by ``rules`` (over name, text and records), before what it names
    is read. A file that two name must be pinned alike; one that an earlier level has admitted is not read again, so a
    ring of names ends. The chain ends where nothing new is named; one of more than ``most_levels`` is refused. ``name`` is the SQL that makes a file's name from its ``path``.
    """
    pins = freeze(first.select("name", "sha", F.col("bytes").cast("long").alias("bytes"), F.lit(None).cast("long").alias("records")))
    done = None
    for level in range(most_levels):
        admit(pins, [row("path", F.col("name").rlike(r"\A[^/\\\x00]+\z") & ~F.col("name").isin(".", "..")), row("pin", (F.col("sha").isNull() & F.lit(level == 0)) | is_digest(F.col("sha"))), key("one_pin", "name")], "name")
        found = _those(spark, root, glob, most, name, pins).select(F.expr(name).alias("name"), F.col("bytes").alias("found"), "body")
        read = freeze(pins.join(found, "name", "left").withColumn("text", F.try_validate_utf8("body").cast("string")))
        own = F.sha2("body", 256)
        judged = [row("bound", F.col("found") <= most), row("length", F.col("bytes").isNull() | (F.col("bytes") == F.col("found"))), row("digest", F.col("sha").isNull() | (F.col("sha") == own)), row("json", F.try_parse_json("text").isNotNull()), key("one_file", "name")]
        admit(read, [*judged, *rules(level)], "name")
        here = read.select(F.lit(level).alias("level"), "name", own.alias("sha"), "text", "records")
        done = here if done is None else done.union(here)
        named = here.select(F.explode(links).alias("l")).select("l.name", "l.sha", F.col("l.bytes").cast("long").alias("bytes"), F.col("l.records").cast("long").alias("records"))
        old = done.select("name", F.col("sha").alias("old_sha"))
        named = freeze(named.distinct().join(old, "name", "left"))
        admit(named, [row("same_digest", F.col("old_sha").isNull() | (F.col("old_sha") == F.col("sha")))], "name")
        pins = freeze(named.where("old_sha is null").drop("old_sha"))
        if pins.isEmpty():
            return done
    raise Refused(f"more than {most_levels} levels")


def collection_links(index: str = "index.json") -> Column:
    """The links of a collection: a receipt's ``indexSha256`` (or ``bundleSha256``) pins the index; ``manifests`` and ``shards`` are lists of path, sha256, bytes and records."""
    get = lambda f: F.get_json_object("text", f"$.{f}")
    pinned = F.coalesce(get("indexSha256"), get("bundleSha256"))
    listed = lambda f: F.transform(F.coalesce(F.from_json(get(f), "array<struct<path:string,sha256:string,bytes:bigint,records:bigint>>"), F.array()), lambda x: F.struct(x["path"].alias("name"), x["sha256"].alias("sha"), x["bytes"].alias("bytes"), x["records"].alias("records")))
    none = F.lit(None).cast("long")
    top = F.when(pinned.isNotNull(), F.array(F.struct(F.lit(index).alias("name"), pinned.alias("sha"), none.alias("bytes"), none.alias("records")))).otherwise(F.array())
    return F.concat(top, listed("manifests"), listed("shards"))


def load_collection(spark: SparkSession, root: str, receipt: str, schema: StructType | str, index: str = "index.json", keys: Sequence[str] = ("schemaVersion", "records"), id: str = "id", glob: str = "*.json", name: str = NAME) -> DataFrame:
    """SRC3, SRC5: the rows of a collection, from its review receipt down through index and manifests to the shards; all of them or :class:`Refused`.

    The receipt must be accepted and name its reviewer and evidence; an index or manifest whose list of shards does not add up to its
    ``recordCount``, or that names more than ``MOST_SHARDS``, is refused. A collection of more shards has several manifests.
    """
    get = lambda f: F.get_json_object("text", f"$.{f}")
    shards = F.from_json(get("shards"), "array<struct<path:string,sha256:string,bytes:bigint,records:bigint>>")
    adds_up = F.aggregate(shards, F.lit(0).cast("long"), lambda n, x: n + x["records"]) == get("recordCount").try_cast("long")
    fine = F.forall(shards, lambda x: F.coalesce(x["records"].between(1, MOST_SHARD_ROWS) & x["bytes"].between(1, DEFAULT_BYTES), F.lit(False)))
    lists = row("manifest", get("shards").isNull() | ((F.size(shards) <= MOST_SHARDS) & adds_up & fine))
    reviewed_ = [row("accepted", get("status") == "accepted"), row("index_digest", is_digest(F.coalesce(get("indexSha256"), get("bundleSha256")))), row("reviewer", F.length(get("reviewer")) > 0), row("evidence", F.length(get("evidenceId")) > 0)]
    first = spark.range(1).select(F.lit(receipt).alias("name"), F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("bytes"))
    found = chain(spark, root, first, collection_links(index), lambda level: reviewed_ if level == 0 else [lists], glob=glob, name=name)
    return _records(found.where("records is not null").where(get("records").isNotNull()).select("name", "text", "records"), schema, keys, id)


def receipt_rules(kind: str) -> list[Rule]:
    """Rules for ``receipt`` (JSON text) of a kind: exact fields, accepted, digests well formed, a real date."""
    if kind not in RECEIPT:
        raise ValueError(f"kind {kind!r}")
    fields = RECEIPT[kind]
    get = lambda f: F.get_json_object("receipt", f"$.{f}")
    shape = has_keys(F.col("receipt"), *fields)
    if kind == "foundation":
        shape = shape | has_keys(F.col("receipt"), *fields, "supersedesBundleSha256")
    plain = [f for f in fields if f not in ("limitations", "checks", "fieldNames")]
    rules = [row("fields", shape), row("accepted", get("status") == "accepted"), row("date", get("reviewedOn").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(get("reviewedOn")).isNotNull())]
    rules += [row(f"known_{f}", F.length(get(f)) > 0) for f in plain]
    rules += [row(f"digest_{f}", is_digest(get(f))) for f in plain if f.endswith("Sha256") or f.endswith("Digest")]
    return rules + [row(f"list_{f}", F.json_array_length(get(f)).isNotNull()) for f in fields if f not in plain]


def reviewed(bundles: DataFrame) -> list[Rule]:
    """Rules for ``bundles(id, body, receipt)``: the review is of these bytes and allows publication."""
    b = lambda p: F.get_json_object("body", f"$.publication.{p}")
    r = lambda p: F.get_json_object("receipt", f"$.{p}")
    sha = F.sha2(F.col("body"), 256)
    return [
        row("bytes", F.coalesce(r("bundleSha256"), r("indexSha256")) == sha), row("accepted", r("status") == "accepted"), row("allowed", b("allowed") == "true"),
        row("no_allegation", b("consequentialAllegation") == "false"), row("same_review", b("reviewId") == r("evidenceId")), row("same_date", b("reviewedOn") == r("reviewedOn")),
    ]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, bytes, modified)`` of the files below a folder as they are listed now; no file is opened."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return read.select(relative(root).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def inventory(spark: SparkSession, root: str, snapshot: str) -> DataFrame:
    """SRC13: ``(snapshot, path, kind, bytes, sha, body)`` of a frozen copy, within bounds, else :class:`Refused`.

    The folder is listed, read once into a frozen copy, and listed again: path, length and time of change of all files must be the same
    three times, by full joins, so a file that is added, removed or changed meanwhile is refused, and one that changes later changes
    nothing. Paths are relative to the root. Bounds on files, entries (folders count), depth and bytes are aggregates of the copy, and no file over
    its bound is read. Folders, at most ``MOST_DEPTH`` within each other, are those that files lie in; Spark's file source leaves out empty files,
    and links on a local disk are out of scope here.
    """
    before = freeze(listing(spark, root))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = before.where(F.size(parts) > 1).select(F.explode(above).alias("path")).distinct()
    bounds = [row("file_bytes", F.col("bytes") <= FILE_BYTES), row("depth", F.size(parts) <= MOST_DEPTH + 1), agg("files", F.count("*") <= MOST_FILES), agg("bytes", F.coalesce(F.sum("bytes"), F.lit(0)) <= SNAPSHOT_BYTES)]
    admit(before, bounds, "path")
    admit(before.select("path").union(folders), [agg("entries", F.count("*") <= MOST_ENTRIES)], "path")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= FILE_BYTES)
    copy = freeze(read.select(relative(root).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha"), F.octet_length("content").alias("got"), F.try_validate_utf8("content").cast("string").alias("body")))
    after = freeze(listing(spark, root))
    for name, other in (("read", copy), ("listed again", after)):
        one, two = before.select("path", "bytes", "modified"), other.select("path", F.col("bytes").alias("b2"), F.col("modified").alias("m2"))
        moved = one.join(two, "path", "full").where(~F.coalesce((F.col("bytes") == F.col("b2")) & (F.col("modified") == F.col("m2")), F.lit(False)))
        if some := moved.select("path").limit(5).collect():
            raise Refused(f"not still when {name}: " + "; ".join(r["path"] for r in some))
    admit(copy, [row("whole", F.col("got") == F.col("bytes"))], "path")
    rows = copy.select(F.lit(snapshot).alias("snapshot"), "path", F.lit("file").alias("kind"), "bytes", "sha", "body")
    none = F.lit(None).cast("string")
    return rows.unionByName(folders.select(F.lit(snapshot).alias("snapshot"), "path", F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("bytes"), none.alias("sha"), none.alias("body")))


def strict_objects(texts: DataFrame, column: str = "body") -> DataFrame:
    """SRC14, SRC11: rows with ``valid``: JSON objects without repeated keys, NaN or Infinity."""
    return texts.withColumn("valid", F.try_parse_json(column).isNotNull() & F.col(column).rlike(r"\A\s*\{"))


__all__ = ["Refused", "chain", "check_path", "collection_links", "files", "inventory", "listing", "load_collection", "load_shards", "manifest_rules", "receipt_rules", "reviewed", "strict_objects", "verified"]
