"""Exact joins and the integrity checks around them. Nothing is matched by name or amount."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes (estimated, files compressed) up to which a side is broadcast; beyond it the engine's own choice stands.
BROADCAST_BYTES = 10_000_000


def small(df: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast only if the optimizer's size estimate is below the bound."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= bound else df


def label(rows: DataFrame, labels: DataFrame, on: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Labels joined onto rows by exact keys; rows without a label keep null.

    A key with several labels would multiply rows, so such labels fail the query when it runs.
    """
    taken = labels.groupBy(*on).agg(*[F.first(c).alias(c) for c in take], F.count("*").alias("__n"))
    refused = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("more than one label for "), F.concat_ws("|", *on)))).otherwise(F.lit(True))
    return rows.join(small(taken.where(refused).select(*on, *take)), list(on), "left")


def label_faults(rows: DataFrame, labels: DataFrame, on: Sequence[str], same: Sequence[str]) -> DataFrame:
    """``(fault, key)`` of labels that occur twice, name no row, or disagree with their row."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in on])
    twice = labels.groupBy(*on).count().where("count > 1").select(F.lit("duplicate").alias("fault"), key.alias("key"))
    lost = labels.join(rows.select(*on).distinct(), list(on), "left_anti").select(F.lit("unmatched").alias("fault"), key.alias("key"))
    other = rows.select(*on, *[F.col(c).alias(f"__{c}") for c in same])
    agrees = reduce(lambda a, b: a & b, [known_equal(F.col(c), F.col(f"__{c}")) for c in same], F.lit(True))
    differ = labels.join(other, list(on)).where(~agrees).select(F.lit("differs").alias("fault"), key.alias("key"))
    return twice.union(lost).union(differ)


def known_equal(a: Column, b: Column) -> Column:
    """Equal and both known: unknown never equals unknown."""
    return F.coalesce(a == b, F.lit(False))


def orphans(child: DataFrame, keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]) -> DataFrame:
    """J3, SET4: rows of ``child`` whose key has a null or is not in ``parent``."""
    renamed = parent.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(parent_keys)]).distinct()
    same = reduce(lambda a, b: a & b, [child[c] == F.col(f"__p{i}") for i, c in enumerate(keys)])
    return child.join(renamed, same, "left_anti")


def linked(left: DataFrame, right: DataFrame, on: Sequence[str], agree: Sequence[str]) -> DataFrame:
    """Left rows by exact key, with ``agrees``: the key is found and all dimensions are known and equal."""
    other = right.select(*on, *[F.col(c).alias(f"__{c}") for c in agree], F.lit(True).alias("__found"))
    agrees = reduce(lambda a, b: a & b, [known_equal(F.col(c), F.col(f"__{c}")) for c in agree], F.coalesce("__found", F.lit(False)))
    joined = left.join(other, list(on), "left").withColumn("agrees", agrees)
    return joined.select(*left.columns, "agrees")


def same_population(claims: DataFrame, members: DataFrame, keys: Sequence[str], claimed: str, member: str) -> DataFrame:
    """J5, SET5: whether each claim lists exactly the members of its group, without repeats.

    Membership is counted, not collected: a claim of n distinct ids all found among n members is equal to them.
    """
    pairs = claims.select(*keys, F.explode(claimed).alias(member))
    listed = pairs.groupBy(*keys).agg(F.count("*").alias("listed"), F.count_distinct(member).alias("different"))
    there = members.groupBy(*keys).agg(F.count("*").alias("members"))
    hit = pairs.distinct().join(members.select(*keys, member).distinct(), [*keys, member], "left_semi").groupBy(*keys).agg(F.count("*").alias("hit"))
    counts = claims.select(*keys).distinct().join(listed, list(keys), "left").join(there, list(keys), "left").join(hit, list(keys), "left").na.fill(0, ["listed", "different", "members", "hit"])
    equal = (F.col("listed") == F.col("different")) & (F.col("listed") == F.col("members")) & (F.col("hit") == F.col("members"))
    return counts.select(*keys, "listed", "members", equal.alias("equal"))


def same_array(a: Column, b: Column) -> Column:
    """Equal arrays, order included, of which neither holds a null."""
    known = ~F.exists(a, lambda x: x.isNull()) & ~F.exists(b, lambda x: x.isNull())
    return F.coalesce(known & (a == b), F.lit(False))


def pinned(children: DataFrame, parents: DataFrame, sha: str = "parent_sha", record: str | None = None) -> DataFrame:
    """Children whose parent bundle, by its exact digest (and record), was admitted."""
    on = [F.col(f"c.{sha}") == F.col("p.sha")] + ([F.col(f"c.{record}") == F.col("p.record_id")] if record else [])
    return children.alias("c").join(parents.alias("p"), on, "left_semi")


def receipts(entries: DataFrame, accepted: DataFrame, required: str = "required") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(admitted entries, optional entries left out, required entries that failed) by their receipts.

    ``accepted``: path, status, evidence_id, reviewed_on, sha. An entry passes if the receipt at its
    path is accepted and names the same review, date and digest.
    """
    r = accepted.select(F.col("path").alias("review_path"), *[F.col(c).alias(f"__{c}") for c in ("status", "evidence_id", "reviewed_on", "sha")])
    passes = F.coalesce((F.col("__status") == "accepted") & (F.col("__evidence_id") == F.col("review_id")) & (F.col("__reviewed_on") == F.col("reviewed_on")) & (F.col("__sha") == F.col("data_sha")), F.lit(False))
    judged = entries.join(r, "review_path", "left").withColumn("__ok", passes).select(*entries.columns, "__ok")
    out = lambda c: judged.where(c).drop("__ok")
    return out(F.col("__ok")), out(~F.col("__ok") & ~F.col(required)), out(~F.col("__ok") & F.col(required))


def equal_pairs(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether two facts that are said to be the same measure are equal; they are never added."""
    a = facts.select(F.col("id").alias("a"), F.col("value").alias("a_value"))
    b = facts.select(F.col("id").alias("b"), F.col("value").alias("b_value"))
    return pairs.join(a, "a", "left").join(b, "b", "left").withColumn("equal", known_equal(F.col("a_value"), F.col("b_value")))
