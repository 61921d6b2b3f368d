"""Declared arithmetic identities over facts: exact, and refused wherever the evidence does not carry them."""

from __future__ import annotations

import functools
from decimal import Decimal, localcontext
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import holds, is_decimal
from ..functions.hashing import is_digest
from ..sources.frozen import freeze

#: The statuses of a result, the modes of a rule and the declarations of native arithmetic (fixed values).
STATUSES = ("flagged_unreviewed", "explained", "insufficient_evidence")
MODES = ("source_native_arithmetic", "monetary_comparison")
NATIVE = ("same_schedule_component_sum", "same_table_documented_asset_identity")
MOST_TERMS = 100
#: Names in the locator of a cell (fixed values).
CELL_NAMES = ("column", "field", "kind", "page", "row", "rowId", "table")
#: What may be wrong with a fact's provenance, what counts first before what counts later; the fields of facts that rules compare.
FLAWS = ("missing provenance", "malformed digest", "noncanonical cell locator")
NEEDED = ("value", "availability", "unit", "currency", "scopeKey", "role", "sourceSnapshotSha256", "financialBasisId", "financialBasisVerified")
#: Whole and fraction digits up to which the JVM's decimals are exact here.
WHOLE, PLACES = 18, 16

TERM = "struct<factId:string,coefficient:int>"
BASIS = "struct<scopeKey:string,unit:string,nativeArithmeticDeclaration:string,mappingConfirmed:boolean,componentSetComplete:boolean,financialBasisId:string>"
RULES = f"id string, version int, operation string, mode string, left array<{TERM}>, right array<{TERM}>, basis {BASIS}"
FACTS = (
    "id string, value string, availability string, unit string, currency string, scopeKey string, role string, sourceFactId string, sourceLocator string, "
    "artifactSha256 string, sourceSnapshotSha256 string, nativeCellLocator string, financialBasisId string, financialBasisVerified boolean"
)


class InvalidDeclaration(ValueError):
    """A rule or fact that is malformed: the whole run fails."""


def _first(*cases: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(c, F.lit(message)) for c, message in cases])


def _declared(rules: DataFrame) -> DataFrame:
    """Rules with their terms in one array and ``problem``: what is wrong with the declaration itself."""
    side = lambda c, name: F.transform(F.coalesce(c, F.array()), lambda t: F.struct(F.lit(name).alias("side"), t["factId"].alias("fact_id"), t["coefficient"].alias("coefficient")))
    terms = F.concat(side(F.col("left"), "left"), side(F.col("right"), "right"))
    rows = rules.withColumn("terms", terms)
    ids = F.transform("terms", lambda t: t["fact_id"])
    problem = _first(
        (~holds((F.col("operation") == "linear_identity") & (F.col("version") == 1)), "unsupported operation or version"),
        (~holds(F.col("mode").isin(*MODES)), "unknown mode"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "repeated fact"),
        ((F.coalesce(F.size("left"), F.lit(0)) < 1) | (F.coalesce(F.size("right"), F.lit(0)) < 1) | (F.size("terms") > MOST_TERMS), "invalid expression size"),
        (F.exists("terms", lambda t: ~holds(t["coefficient"].isin(-1, 1))), "unsigned term"),
    )
    return rows.withColumn("problem", problem)


def _judged(facts: DataFrame) -> DataFrame:
    """``(fact_id, f, flaw, exact, cell)``: what rules need of each fact, with its locator read once.

    ``flaw``: what is wrong with its provenance, as a place in :data:`FLAWS`. A locator is a JSON object whose kind fixes its keys and whose values are plain and known.
    """
    names = [f"cell_{n}" for n in CELL_NAMES]
    loc = F.col("nativeCellLocator")
    read = facts.select("*", F.json_tuple(loc, *CELL_NAMES).alias(*names))
    read = read.withColumn("cell_keys", F.sort_array(F.json_object_keys(loc))).withColumn("cell_types", F.schema_of_variant(F.try_parse_json(loc)))
    keys = lambda *of: F.col("cell_keys") == F.array(*[F.lit(k) for k in sorted(of)])
    shaped = (keys("kind", "page", "table", "row", "column") & (F.col("cell_kind") == "pdf_table_cell")) | (keys("kind", "rowId", "field") & (F.col("cell_kind") == "dataset_cell"))
    plain = ~F.col("cell_types").rlike(": (OBJECT|ARRAY|BOOLEAN|VOID)") & reduce(lambda x, y: x & y, [F.coalesce(F.col(n) != "", F.lit(True)) for n in names])
    lacks = reduce(lambda x, y: x | y, [F.col(c).isNull() | (F.col(c) == "") for c in ("artifactSha256", "sourceSnapshotSha256", "sourceLocator", "sourceFactId", "nativeCellLocator")])
    wrong = (lacks, ~is_digest(F.col("artifactSha256")) | ~is_digest(F.col("sourceSnapshotSha256")), ~holds(shaped & plain))
    flaw = F.coalesce(*[F.when(w, F.lit(i)) for i, w in enumerate(wrong)])
    # a locator's values in the order of their names, whatever order they are written in; values that hold separators stay apart
    cell = F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names])
    return read.select(F.col("id").alias("fact_id"), F.struct(*NEEDED).alias("f"), flaw.alias("flaw"), is_decimal(F.col("value")).alias("exact"), cell.alias("cell"))


def evaluate(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """``(rule_id, status, reasons, left_value, right_value, residual, unit, currency, problem)`` for every rule.

    ``problem`` is null unless the declaration is invalid; then status is null too, and :func:`run`
    refuses the whole set. A missing fact is insufficient evidence at once; else all reasons are
    listed, sorted; without any, the residual of left less right is exact and keeps the most decimal places of its inputs.
    Facts are joined on their id; a rule's at most hundred terms are then one row. Both joins are sorted ones: texts made on the
    way are far longer than the optimizer's estimate from the files, by which facts of any number would be broadcast through the driver.
    """
    declared = _declared(rules)
    terms = declared.select("id", F.posexplode(F.slice("terms", 1, MOST_TERMS)).alias("at", "t"))
    found = terms.select("id", "at", "t.*").join(_judged(facts).hint("merge"), "fact_id", "left")
    packed = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "side", "coefficient", "f", "flaw", "exact", "cell"))).alias("t"))
    rows = declared.drop("terms").join(packed.hint("merge"), "id", "left").withColumn("t", F.coalesce("t", F.array().cast(packed.schema["t"].dataType)))

    any_ = lambda p: F.exists("t", lambda x: F.coalesce(p(x["f"]), F.lit(True)))
    values = lambda name: F.array_distinct(F.transform("t", lambda x: x["f"][name]))
    one_known = lambda name: (F.size(values(name)) == 1) & F.element_at(values(name), 1).isNotNull()
    empty = lambda c: c.isNull() | (c == "")
    missing = F.exists("t", lambda x: x["f"].isNull())
    basis, native = F.col("basis"), F.col("mode") == "source_native_arithmetic"

    first = F.array_min(F.transform("t", lambda x: x["flaw"]))
    provenance = _first(
        *((holds(first == i), text) for i, text in enumerate(FLAWS)),
        (F.size(F.array_distinct(F.transform("t", lambda x: F.struct(x["f"]["sourceSnapshotSha256"], x["cell"])))) < F.size("t"), "same cell twice"),
    )
    money = ~native
    component_sum = basis["nativeArithmeticDeclaration"] == "same_schedule_component_sum"
    reasons = F.array_compact(F.array(
        F.when(any_(lambda f: (f["availability"] != "reported") | f["value"].isNull()), "missing observation"),
        F.when(~holds(basis["mappingConfirmed"]), "mapping not established"),
        F.when(any_(lambda f: empty(f["scopeKey"])), "unknown scope"),
        F.when(~holds((F.size(values("scopeKey")) == 1) & (F.element_at(F.col("t"), 1)["f"]["scopeKey"] == basis["scopeKey"])), "mismatched scope"),
        F.when(any_(lambda f: empty(f["unit"])), "unknown unit"),
        F.when(~holds((F.size(values("unit")) == 1) & (F.element_at(F.col("t"), 1)["f"]["unit"] == basis["unit"])), "mismatched unit"),
        F.when(F.size(values("sourceSnapshotSha256")) != 1, "several sources"),
        F.when(money & ~holds(one_known("currency") & F.element_at(values("currency"), 1).rlike(r"\A[A-Z]{3}\z")), "unknown currency"),
        F.when(money & (empty(basis["financialBasisId"]) | any_(lambda f: f["financialBasisId"] != basis["financialBasisId"])), "undeclared financial basis"),
        F.when(money & any_(lambda f: ~holds(f["financialBasisVerified"])), "unverified financial basis"),
        F.when(native & ~holds(basis["nativeArithmeticDeclaration"].isin(*NATIVE)), "native arithmetic not supported"),
        F.when(holds(component_sum) & ~holds(basis["componentSetComplete"]), "incomplete components"),
    ))
    right = F.filter("t", lambda x: x["side"] == "right")
    roles = F.when(
        holds(component_sum) & (F.exists("t", lambda x: (x["side"] == "left") & ~holds(x["f"]["role"] == "component")) | (F.size(right) != 1) | ~holds(F.element_at(right, 1)["f"]["role"] == "printed_total")),
        F.lit("components and total mixed"),
    )
    rows = rows.withColumn("missing", missing).withColumn("problem", F.coalesce("problem", F.when(~missing, F.coalesce(provenance, roles))))
    rows = rows.withColumn("reasons", F.when(F.col("problem").isNull(), F.when(missing, F.array(F.lit("missing fact"))).otherwise(F.array_sort(F.array_distinct(reasons)))))
    unread = F.exists("t", lambda x: ~holds(x["exact"]))
    rows = rows.withColumn("problem", F.coalesce("problem", F.when((F.size("reasons") == 0) & unread, F.lit("inexact number"))))
    ready = F.col("problem").isNull() & (F.size("reasons") == 0)
    rows = rows.withColumn("inputs", F.when(ready, F.transform("t", lambda x: F.struct(x["side"].alias("side"), x["coefficient"].alias("coefficient"), x["f"]["value"].alias("value")))))
    rows = _sums(rows)
    status = F.when(F.col("problem").isNotNull(), F.lit(None)).when(F.size("reasons") > 0, "insufficient_evidence").when(F.col("sums.zero"), "explained").otherwise("flagged_unreviewed")
    return rows.select(
        F.col("id").alias("rule_id"), status.alias("status"), F.when(F.col("problem").isNull(), F.col("reasons")).alias("reasons"), "sums.left_value", "sums.right_value", "sums.residual",
        F.when(ready, basis["unit"]).alias("unit"), F.when(ready & money, F.element_at(values("currency"), 1)).alias("currency"), "problem",
    )


SUMS = "left_value string, right_value string, residual string, zero boolean"


def _sums(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sums``, a struct of both sides and the residual of ``inputs`` as text; decimals of the JVM where they suffice, else Python's of 200 digits.

    Each step is a column of its own, so that it is worked out once.
    """
    kind = f"decimal(38,{PLACES})"
    whole = lambda v: F.length(F.regexp_extract(v, r"\A-?([0-9]+)", 1))
    places = lambda v: F.length(F.regexp_extract(v, r"\.([0-9]+)\z", 1))
    signed = lambda x: (x["value"].try_cast(f"decimal({WHOLE + PLACES},{PLACES})") * x["coefficient"].cast("decimal(1,0)")).cast(kind)
    read = F.transform("inputs", lambda x: F.struct(x["side"].alias("side"), whole(x["value"]).alias("whole"), places(x["value"]).alias("places"), signed(x).alias("value")))
    rows = rows.withColumn("read", read).withColumn("fits", ~F.exists("read", lambda x: (x["whole"] > WHOLE) | (x["places"] > PLACES)))
    of = lambda name: F.filter("read", lambda x: x["side"] == name)
    side = lambda name: F.struct(
        F.aggregate(of(name), F.lit(0).cast(kind), lambda a, x: (a + x["value"]).cast(kind)).alias("sum"), F.array_max(F.transform(of(name), lambda x: x["places"])).alias("scale"),
    )
    rows = rows.withColumns({"left_side": side("left"), "right_side": side("right")})
    left, right = F.col("left_side"), F.col("right_side")
    rows = rows.withColumn("rest", (left["sum"] - right["sum"]).cast(kind))
    cut = lambda v, n: F.when(n == 0, F.substring_index(v.cast("string"), ".", 1)).otherwise(F.left(v.cast("string"), F.length(v.cast("string")) - PLACES + n))
    fast = F.struct(
        cut(left["sum"], left["scale"]).alias("left_value"), cut(right["sum"], right["scale"]).alias("right_value"),
        cut(F.col("rest"), F.greatest(left["scale"], right["scale"])).alias("residual"), (F.col("rest") == 0).alias("zero"),
    )
    return rows.withColumn("sums", F.when(F.col("fits"), fast).when(~F.col("fits"), _long_sums()(F.when(~F.col("fits"), F.col("inputs")))))


@functools.cache
def _long_sums():
    """Pandas UDF for the few rules with longer numbers; others reach it as null."""

    def one(inputs):
        if inputs is None:
            return (None, None, None, None)
        with localcontext() as ctx:
            ctx.prec = 200
            total = {"left": Decimal(0), "right": Decimal(0)}
            for x in inputs:
                total[x["side"]] += Decimal(x["value"]) * x["coefficient"]
            d = total["left"] - total["right"]
            return (format(total["left"], "f"), format(total["right"], "f"), format(d, "f"), d == 0)

    @F.pandas_udf(SUMS)
    def run(inputs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in inputs], columns=["left_value", "right_value", "residual", "zero"])

    return run


def run(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """:func:`evaluate`, refused as a whole if an id repeats or any declaration is invalid; evaluated once, what was judged is what is returned."""
    rules = freeze(rules)  # read for their ids, for their terms and for the rest
    for table, name in ((rules, "rule"), (facts, "fact")):
        if table.groupBy("id").count().where("count > 1").limit(1).count():
            raise InvalidDeclaration(f"duplicate {name} id")
    results = freeze(evaluate(rules, facts))
    bad = results.where("problem is not null").select("rule_id", "problem").limit(3).collect()
    if bad:
        raise InvalidDeclaration("; ".join(f"{b.rule_id}: {b.problem}" for b in bad))
    return results.drop("problem")


def report(results: DataFrame) -> DataFrame:
    """``(status, n)`` for the three statuses, zeros kept."""
    from .reconcile import histogram

    return histogram(results, "status", STATUSES)


#: Stage pairs that may be compared, and the dimensions that must be known and equal (fixed values).
STAGE_PAIRS = ("original_estimate:amended_estimate", "adjusted_estimate:audited_actual")
DIMENSIONS = ("metric", "currency", "unit", "measureType", "accountingBasis", "reportingPerimeter", "entity", "jurisdiction")


def compare(pairs: DataFrame, strict_stage: bool = True) -> DataFrame:
    """``pairs`` (structs a and b of facts) with ``comparable`` and ``difference`` (b less a, exact text).

    Both are flows of one period, in one known unit and currency, equal in all dimensions; with
    ``strict_stage`` their stages form a pair. Unlike dimensions or missing values give no difference.
    """
    a, b = F.col("a"), F.col("b")
    same = reduce(lambda x, y: x & y, [(F.length(a[d]) > 0) & (a[d] == b[d]) for d in DIMENSIONS])
    period = reduce(lambda x, y: x & y, [a["period"][k] == b["period"][k] for k in ("start", "end", "label")]) & a["period"]["asOf"].isNull() & b["period"]["asOf"].isNull() & (a["period"]["start"] <= a["period"]["end"])
    known = (a["measureType"] == "flow") & (a["multiplier"] == b["multiplier"]) & (a["multiplier"] > 0)
    if strict_stage:
        known = known & F.concat(a["stage"], F.lit(":"), b["stage"]).isin(*STAGE_PAIRS) & (a["currency"] == "CAD")
    ok = holds(same & period & known)
    value = lambda f: F.when(is_decimal(f["rawValue"]) & (F.length(F.regexp_extract(f["rawValue"], r"\.([0-9]+)\z", 1)) <= 6), f["rawValue"].try_cast("decimal(30,6)"))
    return pairs.withColumn("comparable", ok).withColumn("difference", F.when(ok, (value(b) - value(a)).cast("decimal(31,6)").cast("string")))
