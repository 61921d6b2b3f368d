"""The directory of collections and facts, its topics, what it covers, and exports with everything they rest on."""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import differing, writable
from .search import known_or_any

#: The only stage of the chain from budget to outcome that a source record backs comes first (fixed values).
CHAIN = ("budget", "approval", "contract", "payment", "delivery", "outcome")


def directory(collections: DataFrame, facts: DataFrame, topics: Mapping[str, Sequence[str]], fact_topics: Sequence[str] = ("budgets",)) -> DataFrame:
    """SET3: collections and facts as entries of one kind, with the topics they are filed under.

    ``collections``: id, title, scope, count, count_unit. ``facts``: id, title, entity, stage. Topics may overlap.
    """
    filed = F.array_compact(F.array(*[F.when(F.col("id").isin(*ids), F.lit(t)) for t, ids in topics.items()]))
    shape = lambda df, kind, summary, context, under: df.select(F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("id"), F.lit(kind).alias("kind"), "title", summary.alias("summary"), context.alias("context"), under.alias("topics"))
    a = shape(collections, "collection", F.col("scope"), F.concat_ws(" ", F.col("count").cast("string"), "count_unit"), filed)
    b = shape(facts, "fact", F.concat_ws(" · ", "entity", F.translate("stage", "_", " ")), F.lit("source units"), F.array(*map(F.lit, fact_topics)))
    return a.unionByName(b)


def find(entries: DataFrame, query: str = "", kind: str = "", topic: str = "", topics: Sequence[str] = ()) -> DataFrame:
    """entries by words, kind and topic; unknown kinds and topics are no filter."""
    kept = text.all_words(query, "title", "summary", "context") if query else F.lit(True)
    if known_or_any(kind, ("collection", "fact")):
        kept = kept & (F.col("kind") == kind)
    if known_or_any(topic, topics):
        kept = kept & F.array_contains("topics", topic)
    return entries.where(kept)


def topic_counts(entries: DataFrame, kind: str = "collection") -> DataFrame:
    """Entries of a kind by topic; an entry counts once under each, topics without any are left out."""
    return entries.where(F.col("kind") == kind).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@functools.cache
def _https_values(skip: str):
    """Pandas UDF: what :func:`https_urls` gathers from JSON text; an empty array if it is none."""

    def walk(value, found: set) -> None:
        if isinstance(value, dict):
            for name, item in value.items():
                if name in ("url", "sourceURL") and isinstance(item, str) and item.startswith("https://"):
                    found.add(item.split("#")[0])
                elif name != skip:
                    walk(item, found)
        elif isinstance(value, list):
            for item in value:
                walk(item, found)

    def one(text):
        found: set = set()
        try:
            walk(json.loads(text), found)
        except (ValueError, RecursionError):
            return []
        return sorted({writable(u) for u in found})

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else one(v))

    return run


def https_urls(bundles: DataFrame, column: str = "body", skip: str = "sources") -> DataFrame:
    """``(id, urls)``: the https values of ``url`` and ``sourceURL`` keys at any depth of JSON text, sorted.

    Whatever lies under a key named ``skip`` is left out; fragments are dropped and repeats counted once.
    Keys of any name and depth are followed, which no schema can say, so the text is parsed in Python.
    """
    return bundles.select("id", _https_values(skip)(F.col(column)).alias("urls"))


def counted(body: Column, path: str, kind: str) -> Column:
    """What a collection counts: items of a list, a number, or the one case that it is."""
    value = F.get_json_object(body, path)
    if kind == "list":
        return F.json_array_length(value)
    return value.try_cast("int") if kind == "number" else F.lit(1)


def coverage(bundles: DataFrame, receipts: DataFrame) -> DataFrame:
    """A row a collection: what it counts, its digest, its review and its URLs.

    ``bundles``: id, body, count. ``receipts``: id, evidence_id, reviewed_on, sha. A collection whose
    bytes are not the reviewed ones has ``covered`` false.
    """
    urls = https_urls(bundles)
    rows = bundles.select("id", "count", F.sha2(F.col("body"), 256).alias("data_sha")).join(urls, "id")
    rows = rows.join(receipts.select("id", "evidence_id", "reviewed_on", "sha"), "id", "left")
    return rows.withColumn("covered", F.coalesce(F.col("sha") == F.col("data_sha"), F.lit(False))).drop("sha")


def directory_entry(bundles: DataFrame, receipts: DataFrame, count_path: str = "$.records", count_kind: str = "list") -> DataFrame:
    """M5: ``(id, body)``: the directory entry that an admitted bundle and its review make, as JSON.

    ``bundles``: id, body (JSON with title and sourceURL), count_unit, route, scope. ``receipts``: id, evidence_id, reviewed_on.
    """
    get = lambda p: F.get_json_object("body", f"$.{p}")
    path = lambda file: F.concat(F.lit("data/"), F.col("id"), F.lit(f"/{file}.json"))
    fields = {
        "id": F.col("id"), "title": get("title"), "relatedSourceIds": F.array().cast("array<string>"), "dataPath": path("records"), "dataSha256": F.sha2("body", 256), "reviewPath": path("publication-review"), "reviewId": F.col("evidence_id"), "reviewedOn": F.col("reviewed_on"),
        "count": counted(F.col("body"), count_path, count_kind), "countUnit": F.col("count_unit"), "route": F.col("route"), "scope": F.col("scope"), "completeSourceCoverage": F.lit(False), "scheduledRefreshConfigured": F.lit(False), "sourceURLs": F.array(get("sourceURL")),
    }
    entry = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})
    return bundles.join(receipts.select("id", "evidence_id", "reviewed_on"), "id").select("id", entry.alias("body"))


def directory_differences(directory: DataFrame, entries: DataFrame) -> DataFrame:
    """M5: ``(id, path)``: every field in which a directory row (``id, body``) is not what its bundle and review make; the empty path is a whole row that one side lacks."""
    met = directory.select("id", F.col("body").alias("has")).join(entries.select("id", F.col("body").alias("wants")), "id", "full")
    both = met.where("has is not null and wants is not null")
    paths = both.select("id", F.explode(differing()(F.col("has"), F.col("wants"))).alias("path"))
    return paths.union(met.where("has is null or wants is null").select("id", F.lit("").alias("path")))


def available_questions(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """Questions whose collection is in the directory."""
    there = entries.where("kind = 'collection'").select(F.substring_index("id", ":", -1).alias("collection_id"))
    return questions.join(there, "collection_id", "left_semi")


def chain(record: DataFrame, linked: str = "budget", stages: Sequence[str] = CHAIN) -> DataFrame:
    """The fixed chain of stages for each record; only ``linked`` is a source record, the others not established."""
    names = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage"), F.lit("source_record" if s == linked else "not_established").alias("evidence")) for i, s in enumerate(stages)])
    return record.select("id", F.inline(names))


def closure(cases: DataFrame, facts: DataFrame, evidence: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """SNK5: cases with just the facts, evidence and sources they rest on, by semi-joins.

    ``cases``: id, fact_ids, evidence_ids. ``facts``: id, evidence_id. ``evidence``: id, source_id.
    """
    used_facts = facts.join(cases.select(F.explode("fact_ids").alias("id")), "id", "left_semi")
    ids = cases.select(F.explode("evidence_ids").alias("id")).union(used_facts.select("evidence_id"))
    used_evidence = evidence.join(ids, "id", "left_semi")
    return {"cases": cases, "facts": used_facts, "evidence": used_evidence, "sources": sources.join(used_evidence.select(F.col("source_id").alias("id")), "id", "left_semi")}


def record_page(facts: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Each fact with its evidence and source, null where a link is broken."""
    e = evidence.select(F.col("id").alias("evidence_id"), F.struct(*evidence.columns).alias("evidence"), F.col("source_id").alias("__source"))
    s = sources.select(F.col("id").alias("__source"), F.struct(*sources.columns).alias("source"))
    return facts.join(e, "evidence_id", "left").join(s, "__source", "left").drop("__source")


def public_case(cases: DataFrame) -> Column:
    """a case that was reviewed for publication, alleges nothing, and rests on facts and evidence."""
    p = F.col("publication")
    parts = [
        p["allowed"], ~p["consequentialAllegation"], p["reviewType"] == "neutral_source_comparison", F.length(p["reviewId"]) > 0, p["reviewedOn"].rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"),
        F.col("status") == "documented_comparison", F.col("classification") == "calculated_source_comparison", F.size("fact_ids") > 0, F.size("evidence_ids") > 0,
    ]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def seed_facts(seed: DataFrame) -> DataFrame:
    """Rows of twelve positional values as named facts; stage and metric come from the composite id.

    ``seed``: row, values. The id is ``entity|stage|metric``; a value that is no number stays null.
    """
    v = lambda i: F.element_at("values", i)
    part = lambda i: F.regexp_extract(v(1), r"\A([^|]*)\|([^|]*)\|([^|]*)\z", i)
    row = F.col("row").cast("string")
    return seed.select(
        F.concat(F.lit("guide-"), F.lpad(row, F.greatest(F.lit(3), F.length(row)), F.lit("0"))).alias("id"), part(1).alias("entity"), part(2).alias("stage"), part(3).alias("metric"),
        v(2).alias("title"), F.when(v(3).rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"), v(3)).alias("raw_value"), v(4).alias("unit"),
        F.struct(v(5).alias("start"), v(6).alias("end"), v(7).alias("label")).alias("period"), v(8).alias("basis"), v(9).alias("perimeter"), v(10).alias("source_id"), v(11).alias("locator"), v(12).alias("evidence_id"),
    )


def measures(rows: DataFrame, id: str, column: str) -> DataFrame:
    """A map of measures, each a struct of presence and text, as one row a measure."""
    return rows.select(id, F.explode(column).alias("measure", "m")).select(id, "measure", F.col("m.presence").alias("presence"), F.col("m.rawValue").alias("raw_value"))


def tagged_union(**parts: DataFrame) -> DataFrame:
    """Rows of different shapes as one table, each with the name of its group; columns that a part lacks are null."""
    tagged = [df.withColumn("group_id", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
