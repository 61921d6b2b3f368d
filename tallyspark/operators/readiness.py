"""Readiness (ST6): how a checkout differs from what was reviewed. It observes and grants nothing.

Every part gives issues as rows; :func:`report` makes one row of them. What is compared is compared with its kind: the
number 200 is not the text ``"200"``, and a flag is off only if it is ``false``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import instant
from ..functions.exact import holds
from ..functions.hashing import is_digest

#: Bytes of a file that is read (fixed value).
MOST_BYTES = 8 << 20
#: Days between the accepted retrieval and the next attempt at the earliest (fixed value).
FLOOR_DAYS = 7
#: What a report says, by whether there are issues (fixed values).
DRIFT, INACTIVE = "repository_drift_requires_review", "inactive_requires_operational_review"
#: Text by which a limitation of a source is a hold (fixed value).
HOLD = "access hold"

_PART = r"(?!\.{1,2}(?:/|\z))[^/]+"


def typed(raw: Column) -> Column:
    """JSON text as one form for each value and kind, whatever its white space and the order of its keys; null if it is not JSON."""
    return F.to_json(F.try_parse_json(raw))


def set_issues(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """``(set, value, problem)``: how observed sets differ from expected ones; both are ``(set, value)``, a value as JSON text.

    ``unexpected``: observed only; ``missing``: expected only; ``repeated``: observed more than once; ``not a value``: no JSON, on either side.
    A null value is no JSON, a null set is a set like any other. Both sides are counted together, in one shuffle with partial sums.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = [df.select("set", F.coalesce(typed(F.col("value")), F.col("value")).alias("value"), typed(F.col("value")).isNotNull().alias("valid"), a.alias("seen"), b.alias("wanted")) for df, a, b in ((observed, one, none), (expected, none, one))]
    counts = sides[0].union(sides[1]).groupBy("set", "value", "valid").agg(F.sum("seen").alias("seen"), F.sum("wanted").alias("wanted"))
    problem = F.when(~F.col("valid"), "not a value").when(F.col("wanted") == 0, "unexpected").when(F.col("seen") == 0, "missing").when(F.col("seen") > 1, "repeated")
    return counts.select("set", "value", problem.alias("problem")).where("problem is not null")


def manifest_pins(files: DataFrame, pins: DataFrame, manifests: DataFrame) -> DataFrame:
    """``(path, sha)``: the pins, and those that pinned manifests list as ``{"files": {name: sha}}``.

    ``files``: path, kind, bytes, sha, body (text, read for manifests only). ``pins``: path, sha. ``manifests``: path, base, the folder that names are relative to.
    A manifest whose bytes are not the pinned ones is not followed; that it changed is an issue of its own. What is pinned twice is there twice.
    """
    right = files.where(F.col("body").isNotNull() & (F.col("kind") == "file") & (F.col("bytes") <= MOST_BYTES)).select("path", F.col("sha").alias("found"), "body")
    pinned = right.join(pins.select("path", "sha"), "path").where(holds(F.col("found") == F.col("sha"))).drop("found", "sha")  # with the digest as a key, bodies would be dealt out once more for the next join
    followed = pinned.join(manifests, "path").select("base", F.explode(F.from_json(F.get_json_object("body", "$.files"), "map<string,string>")).alias("name", "sha"))
    return pins.select("path", "sha").union(followed.select(F.concat_ws("/", "base", "name"), "sha"))


def pin_issues(files: DataFrame, pins: DataFrame, parts: int | None = None) -> DataFrame:
    """``(path, reason)`` of pins that do not hold; ``files``: path, kind, bytes, sha, a row for each thing found; ``pins``: path, sha.

    A pin of a path that leaves the checkout, of something missing, oversized or no regular file (a link is none), or of other bytes
    is an issue, and so is one without a digest or of a path with two things. A path pinned to two digests is one for at least one of them.
    Each side is dealt out once, by path, to ``parts`` (by default as many as the session says), with digests as bytes.
    """
    deal = lambda df: df.repartition(parts, "path") if parts else df.repartition("path")
    digest, good = F.unhex("sha"), is_digest(F.col("sha"))
    regular = holds((F.col("kind") == "file") & (F.col("bytes") <= MOST_BYTES))
    found = deal(files.select("path", regular.alias("regular"), F.when(good, digest).alias("found"))).groupBy("path").agg(F.count("*").alias("things"), F.bool_and("regular").alias("regular"), F.max("found").alias("found"))
    wanted = deal(pins.select("path", F.when(good, digest).alias("digest"), F.when(~good, F.col("sha")).alias("other"))).distinct()
    joined = wanted.join(found, "path", "left")
    reason = (
        F.when(~holds(F.col("path").rlike(rf"\A{_PART}(?:/{_PART})*\z")), "invalid path")
        .when(~holds((F.col("things") == 1) & F.col("regular")), "missing, not a regular file or too large")
        .when(~holds(F.col("digest") == F.col("found")), "pinned bytes changed")
    )
    return joined.select("path", reason.alias("reason")).where("reason is not null")


def flag_issues(values: DataFrame, required: DataFrame) -> DataFrame:
    """``(path, name, reason)`` of required flags that are not off: ``values``: path, name, value (JSON text), a row an assignment; ``required``: path, name.

    A flag has to be assigned exactly once and to be ``false``; ``0``, null and the text ``"false"`` are not.
    """
    once = values.groupBy("path", "name").agg(F.count("*").alias("n"), F.max(typed(F.col("value"))).alias("value"))
    joined = required.select("path", "name").distinct().join(once, ["path", "name"], "left")
    reason = F.when(~holds(F.col("n") == 1), "not assigned exactly once").when(~holds(F.col("value") == "false"), "not disabled")
    return joined.select("path", "name", reason.alias("reason")).where("reason is not null")


def binding_problems(baselines: DataFrame, reviews: DataFrame, declared: DataFrame) -> DataFrame:
    """``(name, problems)``: each baseline, its review and what the code declares of both, bound to each other; an empty array: none.

    ``baselines`` and ``reviews``: name, body (JSON text); ``declared``: name, baseline_sha, review_sha. The review is accepted and names the
    baseline's digest, and the declared digests are those of both. Each has to be there once. The baseline tells when it was retrieved.
    """
    none = F.lit(None).cast("string")
    get = lambda p: F.get_json_object("body", f"$.{p}")
    sha = F.sha2(F.col("body"), 256)
    kinds = ("baseline", "review", "declaration")
    cells = lambda kind, **known: ["name", F.lit(kind).alias("kind"), *[known.get(c, none).alias(c) for c in ("sha", "status", "names", "retrieved", "says_baseline", "says_review")]]
    rows = [
        baselines.select(*cells("baseline", sha=sha, retrieved=get("source.capturedAt"))),
        reviews.select(*cells("review", sha=sha, status=F.to_json(F.try_variant_get(F.try_parse_json("body"), "$.status", "variant")), names=get("bundleSha256"))),
        declared.select(*cells("declaration", says_baseline=F.col("baseline_sha"), says_review=F.col("review_sha"))),
    ]
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    met = reduce(DataFrame.union, rows).groupBy("name").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], of("baseline", "sha").alias("baseline_sha"), of("review", "sha").alias("review_sha"),
        *[F.max(c).alias(c) for c in ("status", "names", "retrieved", "says_baseline", "says_review")],
    )
    checks = {f"not one {k}": F.col(k) == 1 for k in kinds} | {
        "review is not accepted": F.col("status") == '"accepted"', "review is of other bytes": F.col("names") == F.col("baseline_sha"), "declared baseline differs": F.col("says_baseline") == F.col("baseline_sha"),
        "declared review differs": F.col("says_review") == F.col("review_sha"), "unknown time of retrieval": instant(F.col("retrieved")).isNotNull(),
    }
    return met.select("name", F.array_compact(F.array(*[F.when(~holds(ok), F.lit(text)) for text, ok in checks.items()])).alias("problems"))


def provenance(baselines: DataFrame, problems: DataFrame) -> DataFrame:
    """``(name, dataset, observations, baseline_sha, retrieved, floor)`` of baselines without problems; the floor is a lower bound of the past, no date of a next run."""
    get = lambda p: F.get_json_object("body", f"$.{p}")
    at = instant(get("source.capturedAt"))
    good = baselines.join(problems.where(F.size("problems") == 0).select("name"), "name", "left_semi")
    return good.select("name", get("source.datasetId").alias("dataset"), F.json_array_length(get("records")).alias("observations"), F.sha2("body", 256).alias("baseline_sha"), at.alias("retrieved"), (at + F.expr(f"interval {FLOOR_DAYS} days")).alias("floor"))


def retained_holds(sources: DataFrame) -> DataFrame:
    """``(id, url, statements)``: sources whose limitations speak of an access hold, in their words; absence is no clearance. ``sources``: id, url, limitations."""
    said = F.filter("limitations", lambda s: F.contains(F.lower(s), F.lit(HOLD)))
    return sources.select("id", "url", said.alias("statements")).where(F.size("statements") > 0)


def report(**issues: DataFrame) -> DataFrame:
    """One row: status, whether the boundary is as reviewed, the number of issues of each part; nothing is ever authorised."""
    every = reduce(DataFrame.union, [df.select(F.lit(part).alias("part")) for part, df in issues.items()])
    counts = every.agg(*[F.count_if(F.col("part") == part).alias(part) for part in issues])
    clean = reduce(lambda a, b: a & b, [F.col(part) == 0 for part in issues])
    return counts.select(F.when(clean, INACTIVE).otherwise(DRIFT).alias("status"), clean.alias("boundary_verified"), F.lit(False).alias("collection_authorized"), F.lit(False).alias("publication_allowed"), *issues)
