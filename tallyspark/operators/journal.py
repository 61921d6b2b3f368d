"""Collection journals: may the next attempt start, what do retained snapshots show, and refresh candidates."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_order, instant
from ..functions.exact import holds, in_bound
from ..functions.hashing import is_digest, same_json
from .diff import change_counts, changes, coverage

#: Days between attempts, seconds of a request and of a pair of requests (fixed values).
DAYS, REQUEST_SECONDS, PAIR_SECONDS = 7, 40, 150
#: Bytes of a captured body, and what a receipt says of one that may be read on (fixed values).
MOST_BODY, DISPOSITION = 1 << 20, "received_for_semantic_review"
#: Text by which a body gives itself away as an access challenge (fixed value).
CHALLENGE = "(?i)captcha|access.denied|request rejected|challenge-platform|cf-chl"
#: Files of an attempt and of the journal itself (fixed values).
KINDS = ("robots", "metadata", "payments")
ATTEMPT_FILES = ("admission.json", "outcome.json", "robots-decisions.json", "candidate.private.json")
TOP_FILES = ("baseline-retrieval.json", "hold.json", "active.lock", "attempts")


def fold(events: DataFrame) -> DataFrame:
    """ST2: the latest status of each attempt; ``events``: dataset, attempt, seq, kind, status, at."""
    last = F.struct("seq", "kind", "status")  # equal numbers: the later kind and status by name, so that the result does not depend on the order of rows
    return events.groupBy("dataset", "attempt").agg(F.max_by("status", last).alias("status"), F.max_by("kind", last).alias("kind"), F.max("at").alias("at"))


def admission(events: DataFrame, now: Column) -> DataFrame:
    """ST1, ST3: ``(dataset, may_start, reason)`` from a journal that starts with the accepted baseline.

    A hold or lock refuses, then any attempt without an outcome or with another than a prepared
    candidate, then less than a week since the latest known time. A dataset without a baseline is refused.
    """
    latest = fold(events)
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    facts = latest.groupBy("dataset").agg(
        has(F.col("kind") == "hold").alias("held"), has(F.col("kind") == "lock").alias("locked"), has(F.col("kind") == "baseline").alias("seeded"),
        has(F.col("kind").isin("admission", "attempt", "receipt")).alias("open"), has((F.col("kind") == "outcome") & ~holds(F.col("status") == "candidate_prepared")).alias("failed"),
        F.max("at").alias("last"),
    )
    reason = (
        F.when(F.col("held"), "hold").when(F.col("locked"), "lock").when(~F.col("seeded"), "no baseline").when(F.col("open"), "unresolved attempt").when(F.col("failed"), "failed attempt")
        .when(~holds(now >= F.col("last") + F.expr(f"interval {DAYS} days")), "cadence")
    )
    return facts.select("dataset", reason.isNull().alias("may_start"), reason.alias("reason"))


def findings(artifacts: DataFrame, baseline: str | None = None, endpoints: Mapping[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """ST4: ``(snapshot, code, path)``: what in retained snapshots needs review; nothing is dropped or cleared.

    ``artifacts``: snapshot, path, kind, bytes, sha, body (text of journal files, else null). With ``baseline`` (JSON text) the accepted
    baseline's history must be that, whatever the order of its keys; with ``endpoints`` (kind to URL) requests and responses must be theirs.
    Values of a receipt are compared with their kind: a status of ``"200"`` as text is not 200.

    Nothing is joined: what a file is bound to and which files a run has are sums of one row a file and one a run, in ``parts`` of snapshots
    (by default as many as the session says).
    """
    deal = lambda df, *keys: df.repartition(parts, *keys) if parts else df.repartition(*keys)
    run = F.regexp_extract("path", r"\Aattempts/([^/]+)", 1)
    name = F.regexp_extract("path", r"\Aattempts/[^/]+/(.+)\z", 1)
    rows = artifacts.withColumn("run", run).withColumn("name", name)
    parsed = F.try_parse_json("body")
    journal = F.col("path").endswith(".json") | (F.col("path") == "active.lock") | F.col("path").rlike(r"\.(attempt|receipt)\.json\z")
    get = lambda p: F.get_json_object("body", f"$.{p}")
    literal = lambda p: F.to_json(F.try_variant_get(parsed, f"$.{p}", "variant"))
    code = lambda cond, text: F.when(cond, F.lit(text))
    is_receipt, is_attempt = F.col("name").endswith(".receipt.json"), F.col("name").endswith(".attempt.json")
    good = parsed.isNotNull()
    unknown = ~F.col("path").isin(*TOP_FILES) & ~((F.col("run") != "") & ((F.col("name") == "") | F.col("name").isin(*ATTEMPT_FILES, *[f"{k}{s}" for k in KINDS for s in (".attempt.json", ".receipt.json", ".body")])))
    endpoint = F.coalesce(*[F.when(F.col("name").startswith(f"{k}."), F.lit(u)) for k, u in (endpoints or {"": ""}).items()])
    right_response = (get("responseURL") == endpoint) if endpoints else F.lit(True)
    single = F.array_compact(F.array(
        code((F.col("kind") == "file") & journal & ~good, "malformed_journal_record"),
        code(F.col("path") == "hold.json", "persistent_hold_preserved"),
        code(F.col("path") == "active.lock", "unresolved_lock_preserved"),
        code((F.col("path") == "attempts") & (F.col("kind") != "directory"), "journal_directory_type_invalid"),
        code((F.col("path") == "hold.json") & good & get("completedAtEpoch").try_cast("double").isNull(), "unknown_hold_or_lock_time"),
        code((F.col("path") == "active.lock") & good & instant(get("startedAt")).isNull(), "unknown_hold_or_lock_time"),
        code((F.col("name") == "outcome.json") & good & get("completedAtEpoch").try_cast("double").isNull(), "unknown_completion_time"),
        code((F.col("name") == "outcome.json") & good & ~holds(get("status") == "candidate_prepared"), "failed_or_unknown_outcome_preserved"),
        code(good & (((is_attempt | is_receipt) & instant(get("attemptedAt")).isNull()) | (is_receipt & instant(get("completedAt")).isNull())), "unknown_request_time"),
        code(is_receipt & good & ~holds((literal("status") == "200") & (literal("complete") == "true") & (literal("headersComplete") == "true") & get("transportError").isNull() & (get("workerTermination") == "confirmed") & right_response), "failed_or_uncertain_response_preserved"),
        code(unknown, "unrecognized_artifact_preserved"),
        *([code((F.col("path") == TOP_FILES[0]) & good & ~same_json(F.col("body"), F.lit(baseline)), "accepted_baseline_history_mismatch")] if baseline is not None else []),
        *([code((is_attempt | is_receipt) & good & ~holds(get("url") == endpoint), "unexpected_endpoint_preserved")] if endpoints else []),
    ))
    alone = deal(rows.select("snapshot", F.explode(single).alias("code"), "path"), "snapshot", "path").distinct()

    claiming = good & (is_receipt | ((F.col("name") == "outcome.json") & holds(get("status") == "candidate_prepared")))
    body, none = F.when(is_receipt, F.regexp_replace("path", r"\.receipt\.json\z", ".body")).otherwise(F.regexp_replace("path", r"outcome\.json\z", "candidate.private.json")), F.lit(None)
    side = lambda path, claim, receipt, sha, size: F.struct(path.alias("bound"), claim.cast("string").alias("claim"), receipt.alias("receipt"), sha.alias("sha"), size.cast("long").alias("size"))
    claim = F.when(holds(claiming), side(body, F.col("path"), is_receipt, F.when(is_receipt, get("bodySha256")).otherwise(F.when(get("publicationAllowed") == "false", get("candidateSha256"))), get("bodyBytes").try_cast("long")))
    known = F.when(holds(F.col("kind") == "file") & F.col("snapshot").isNotNull() & (F.col("path").endswith(".body") | F.col("path").endswith("candidate.private.json")), side(F.col("path"), none, F.lit(False), F.col("sha"), F.col("bytes")))
    sides = deal(rows.select("snapshot", F.inline(F.array_compact(F.array(claim, known)))), "snapshot", "bound").withColumn("claims", F.col("claim").isNotNull())
    # a claim holds if all that is said of a path is one thing and all that is there is that; claims on one path are those of one file
    of = lambda said, c: F.when(F.col("claims") == said, F.col(c))
    sums = {f"{end}_{c}_{who}": use(of(said, c)) for who, said in (("said", True), ("there", False)) for c in ("sha", "size") for end, use in (("first", F.min), ("last", F.max), ("n", F.count))}
    met = sides.groupBy("snapshot", "bound").agg(F.max("claim").alias("path"), F.bool_or("receipt").alias("receipt"), F.count_if("claims").alias("said"), F.count_if(~F.col("claims")).alias("there"), *[v.alias(k) for k, v in sums.items()])
    one = lambda c: (
        (F.col(f"n_{c}_said") == F.col("said")) & (F.col(f"n_{c}_there") == F.col("there")) & (F.col(f"first_{c}_said") == F.col(f"last_{c}_said"))
        & (F.col(f"first_{c}_there") == F.col(f"last_{c}_there")) & (F.col(f"first_{c}_said") == F.col(f"first_{c}_there"))
    )
    broken = (F.col("said") > 0) & ~holds((F.col("there") > 0) & one("sha") & (~F.col("receipt") | one("size")))
    bindings = met.where(broken).select("snapshot", F.when(F.col("receipt"), "response_body_binding_unverified").otherwise("candidate_outcome_binding_unverified").alias("code"), "path")

    records = ("outcome.json", "admission.json", "robots-decisions.json", *[f"{k}{s}" for k in KINDS for s in (".attempt.json", ".receipt.json")])
    present = F.col("snapshot").isNotNull()
    seen = deal(rows.where("run <> ''").select("snapshot", "run", F.when(present, F.col("name")).alias("name")), "snapshot", "run")
    runs = seen.groupBy("snapshot", "run").agg(*[F.bool_or(holds(F.col("name") == f)).alias(f) for f in records])
    lacks = F.array_compact(F.array(*[F.when(~F.col(f"`{f}`"), F.concat(F.lit("attempts/"), F.col("run"), F.lit(f"/{f}"))) for f in records]))
    first = deal(rows.select("snapshot", holds(present & (F.col("path") == TOP_FILES[0])).alias("there")), "snapshot").groupBy("snapshot").agg(F.bool_or("there").alias("there"))
    wanted = runs.select("snapshot", F.explode(lacks).alias("path")).union(first.where(~F.col("there")).select("snapshot", F.lit(TOP_FILES[0])))
    missing = wanted.select("snapshot", F.lit("missing_journal_record").alias("code"), "path")
    return alone.union(bindings).union(missing)


def plan_status(found: DataFrame, conflicts: DataFrame, issues: DataFrame) -> DataFrame:
    """ST5: one row ``(status, findings, conflicts, issues)``: a plan with anything open is input that requires review, and nothing it says authorises more."""
    parts = {"findings": found, "conflicts": conflicts, "issues": issues}
    every = reduce(DataFrame.union, [df.select(F.lit(name).alias("part")) for name, df in parts.items()])
    counts = every.agg(*[F.count_if(F.col("part") == name).alias(name) for name in parts])
    status = F.when(F.col("findings") + F.col("conflicts") + F.col("issues") > 0, "input_requires_review").otherwise("review_plan_only")
    return counts.select(status.alias("status"), "findings", "conflicts", "issues")


#: What the metadata of the refreshed dataset must say (fixed values).
IDENTITY = {
    "id": "xpt9-p9is", "provenance": "official", "licenseId": "OGL_NOVA_SCOTIA", "publicationStage": "published", "assetType": "dataset",
    "owner.id": "9pyy-md4w", "owner.displayName": "Open Data Nova Scotia", "owner.screenName": "Open Data Nova Scotia",
}
TYPES = ("text", "text", "text", "number")


def metadata_problems(metadata: DataFrame, names: Sequence[str], fields: Sequence[str], types: Sequence[str] = TYPES, identity: Mapping[str, str] = IDENTITY) -> DataFrame:
    """§2.12: ``metadata(name, body)`` with ``problems``: identity, licence, stage, owner or columns that are not the reviewed ones, in their order."""
    get = lambda p: F.get_json_object("body", f"$.{p}")
    listed = F.from_json(get("columns"), "array<struct<name:string,fieldName:string,dataTypeName:string>>")
    checks = {p: get(p) == v for p, v in identity.items()}
    for label, key, wanted in (("column names", "name", names), ("column fields", "fieldName", fields), ("column types", "dataTypeName", types)):
        checks[label] = F.transform(listed, operator.itemgetter(key)) == F.array(*map(F.lit, wanted))
    return metadata.withColumn("problems", F.array_compact(F.array(*[F.when(~holds(ok), F.lit(name)) for name, ok in checks.items()])))


def clocks(artifacts: DataFrame) -> DataFrame:
    """All known times in journal files, as ``(snapshot, at)``; what cannot be read is left out here and is a finding."""
    get = lambda p: F.get_json_object("body", f"$.{p}")
    known = F.array_compact(F.array(*[instant(get(p)) for p in ("attemptedAt", "completedAt", "startedAt", "retrievedAt")], F.timestamp_seconds(get("completedAtEpoch").try_cast("double"))))
    return artifacts.where("body is not null").select("snapshot", F.explode(known).alias("at"))


def capture_problems(captures: DataFrame) -> DataFrame:
    """``captures`` with ``problems``: why a body and its receipt are not to be used; an empty array: none.

    A capture: name, body (binary), wanted_url, wanted_type, receipt (JSON text). Nothing is tried again. Values of the receipt are
    compared with their kind: a status of ``"200"`` as text is not 200, and a response address of null is not the wanted one.
    """
    get = lambda p: F.get_json_object("receipt", f"$.{p}")
    literal = lambda p: F.to_json(F.try_variant_get(F.try_parse_json("receipt"), f"$.{p}", "variant"))
    text = F.try_validate_utf8("body").cast("string")
    mime = F.trim(F.lower(F.substring_index(get("headers.content-type"), ";", 1)))
    length = F.regexp_replace(get("headers.content-length"), r"\A[ \t]+|[ \t]+\z", "")
    same_length = length.rlike(r"\A[0-9]+\z") & (F.coalesce(F.nullif(F.ltrim(length, F.lit("0")), F.lit("")), F.lit("0")) == F.octet_length("body").cast("string"))
    times = [instant(get(p)) for p in ("attemptedAt", "headersReceivedAt", "completedAt")]
    checks = {
        "empty body": F.octet_length("body") > 0,
        "oversized body": F.octet_length("body") <= MOST_BODY,
        "not UTF-8": text.isNotNull(),
        "unexpected response": (get("url") == F.col("wanted_url")) & (literal("status") == "200") & (literal("complete") == "true"),
        "disposition": get("disposition") == DISPOSITION,
        "response address": literal("responseURL").isNull() | (get("responseURL") == F.col("wanted_url")),
        "incomplete headers": F.coalesce(literal("headersComplete"), F.lit("")) != "false",
        "body is not the receipt's": (literal("bodyBytes") == F.octet_length("body").cast("string")) & (get("bodySha256") == F.sha2("body", 256)),
        "unexpected type": mime == F.col("wanted_type"),
        "unexpected encoding": F.coalesce(get("headers.content-encoding"), F.lit("identity")) == "identity",
        "content length": get("headers.content-length").isNull() | same_length,
        "transport error": get("transportError").isNull() & (F.coalesce(get("workerTermination"), F.lit("confirmed")) == "confirmed"),
        "chronology": in_order(REQUEST_SECONDS, *times),
        "access challenge": ~text.rlike(CHALLENGE),
    }
    return captures.withColumn("problems", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])))


def pair_problem(first_start: Column, first_end: Column, second_start: Column, second_end: Column) -> Column:
    """Two captures in order, within the time of a pair: what is wrong, or null."""
    return F.when(~holds(first_end <= second_start), "wrong order").when(~holds(second_end.cast("double") - first_start.cast("double") <= PAIR_SECONDS), "too far apart")


def row_problems(rows: DataFrame, baseline: DataFrame, most_rows: int = 2_000) -> DataFrame:
    """§2.12: ``(key, problem)`` of candidate rows ``(year, type, subcategory, amount)``; an empty population is one too.

    Labels that the baseline does not know are withheld for review, repeated keys are not merged.
    """
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("null")) for c in ("year", "type", "subcategory")])
    years = F.regexp_extract("year", r"\A(20[0-9]{2})-(20[0-9]{2})\z", 1), F.regexp_extract("year", r"\A(20[0-9]{2})-(20[0-9]{2})\z", 2)
    known = baseline.select("type", "subcategory").distinct()
    bad_year = ~holds(years[1].try_cast("int") == years[0].try_cast("int") + 1)
    parts = [
        rows.where(bad_year).select(key.alias("key"), F.lit("reporting year").alias("problem")),
        rows.join(known, ["type", "subcategory"], "left_anti").select(key.alias("key"), F.lit("new label withheld").alias("problem")),
        rows.groupBy("year", "type", "subcategory").count().where("count > 1").select(key.alias("key"), F.lit("duplicate key").alias("problem")),
        rows.where(~in_bound(F.col("amount"))).select(key.alias("key"), F.lit("amount").alias("problem")),
        rows.agg(F.count("*").alias("n")).where(f"n = 0 or n > {most_rows}").select(F.lit("*").alias("key"), F.lit("population size").alias("problem")),
    ]
    return reduce(DataFrame.union, parts)


class Hold(ValueError):
    """A refresh that stops for review."""


def candidate(rows: DataFrame, baseline: DataFrame, most_rows: int = 2_000, captures: DataFrame | None = None, metadata: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """§2.12: (changes by key, coverage by year) of a candidate against the accepted baseline; never summed, never published.

    Raises :class:`Hold` if any row has a problem, or if one of the ``captures`` (:func:`capture_problems`, with the columns first_start,
    first_end, second_start, second_end of its pair) or of the ``metadata`` (:func:`metadata_problems`) has.
    """
    for name, found in (("capture", captures), ("metadata", metadata)):
        if found is not None:
            if name == "capture":
                pair = pair_problem(*map(F.col, ("first_start", "first_end", "second_start", "second_end")))
                found = found.withColumn("problems", F.array_compact(F.concat("problems", F.array(pair))))
            open_ = found.where(F.size("problems") > 0).limit(3).collect()
            if open_:
                raise Hold("; ".join(f"{name} {r['name']}: {', '.join(r['problems'])}" for r in open_))
    bad = row_problems(rows, baseline, most_rows).limit(3).collect()
    if bad:
        raise Hold("; ".join(f"{b.key}: {b.problem}" for b in bad))
    changed = changes(baseline, rows, ["year", "type", "subcategory"], "amount")
    return changed, coverage(changed, "year", ["year", "type", "subcategory"])


def year_counts(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    return change_counts(changes(baseline, rows, ["year", "type", "subcategory"], "amount"), "year")


def ready(pins: DataFrame, files: DataFrame, holds_: DataFrame, flags: DataFrame) -> DataFrame:
    """ST6, J19: ``(check, detail)`` for each pinned path whose file is missing or other bytes, each retained hold, and each flag that should be off.

    ``pins``: path, sha. ``files``: path, sha. ``holds_``: path. ``flags``: name, enabled.
    """
    joined = pins.join(files.select("path", F.col("sha").alias("found")), "path", "left")
    drift = joined.where(~holds((F.col("sha") == F.col("found")) & is_digest(F.col("sha")))).select(F.lit("pin").alias("check"), F.col("path").alias("detail"))
    kept = holds_.select(F.lit("hold").alias("check"), F.col("path").alias("detail"))
    on = flags.where(~holds(~F.col("enabled"))).select(F.lit("flag").alias("check"), F.col("name").alias("detail"))
    return drift.union(kept).union(on)
