import json

import pytest

from tallyspark.operators import adapters, identity
from tallyspark.sources.frozen import freeze

SHA = "a" * 64


def fact(id, value, role="component", **more):
    base = dict(
        id=id, value=value, availability="reported", unit="dollars", currency=None, scopeKey="s", role=role, sourceFactId=id, sourceLocator="table", artifactSha256=SHA, sourceSnapshotSha256=SHA,
        nativeCellLocator=json.dumps({"kind": "dataset_cell", "rowId": id, "field": "v"}), financialBasisId=None, financialBasisVerified=None,
    )
    return base | more


def rule(id, left, right, **more):
    basis = dict(scopeKey="s", unit="dollars", nativeArithmeticDeclaration="same_schedule_component_sum", mappingConfirmed=True, componentSetComplete=True, financialBasisId=None)
    base = dict(id=id, version=1, operation="linear_identity", mode="source_native_arithmetic", left=[(f, 1) for f in left], right=[(f, 1) for f in right], basis=basis)
    basis.update({k: more.pop(k) for k in list(more) if k in basis})
    return base | more


def frames(spark, rules, facts):
    return (
        spark.createDataFrame([(r["id"], r["version"], r["operation"], r["mode"], r["left"], r["right"], tuple(r["basis"][k] for k in ("scopeKey", "unit", "nativeArithmeticDeclaration", "mappingConfirmed", "componentSetComplete", "financialBasisId"))) for r in rules], identity.RULES),
        spark.createDataFrame([tuple(f[c.split()[0]] for c in identity.FACTS.split(", ")) for f in facts], identity.FACTS),
    )


FACTS = [fact("a", "68201.98"), fact("b", "0.00"), fact("t", "67201.98", "printed_total"), fact("u", "68201.98", "printed_total")]


def results(spark, rules, facts=FACTS):
    return {r.rule_id: r for r in identity.evaluate(*frames(spark, rules, facts)).collect()}


def test_three_statuses(spark):
    got = results(spark, [rule("flag", ["a", "b"], ["t"]), rule("fine", ["a", "b"], ["u"]), rule("gone", ["a", "zzz"], ["t"])])
    assert (got["flag"].status, got["flag"].residual, got["flag"].left_value) == ("flagged_unreviewed", "1000.00", "68201.98")
    assert (got["fine"].status, got["fine"].residual) == ("explained", "0.00")
    assert (got["gone"].status, got["gone"].reasons, got["gone"].residual) == ("insufficient_evidence", ["missing fact"], None)
    report = {r.status: r.n for r in identity.report(identity.run(*frames(spark, [rule("flag", ["a", "b"], ["t"])], FACTS))).collect()}
    assert report == {"flagged_unreviewed": 1, "explained": 0, "insufficient_evidence": 0}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        (dict(value=None), "missing observation"), (dict(availability="withheld"), "missing observation"), (dict(unit=None), "unknown unit"), (dict(unit="cents"), "mismatched unit"),
        (dict(scopeKey=""), "unknown scope"), (dict(scopeKey="other"), "mismatched scope"), (dict(sourceSnapshotSha256="b" * 64), "several sources"),
    ],
)
def test_evidence_that_does_not_carry(spark, change, reason):
    got = results(spark, [rule("r", ["a", "b"], ["t"])], [fact("a", "68201.98") | change, *FACTS[1:]])["r"]
    assert got.status == "insufficient_evidence" and reason in got.reasons and got.problem is None


@pytest.mark.parametrize(
    ("made", "problem"),
    [
        (rule("r", ["a", "a"], ["t"]), "repeated fact"), (rule("r", [], ["t"]), "invalid expression size"), (rule("r", ["a"], ["t"], version=2), "unsupported operation or version"),
        (rule("r", ["a"], ["t"], mode="other"), "unknown mode"), (rule("r", ["t"], ["u"]), "components and total mixed"), (rule("r", ["a"], ["t"]) | {"left": [("a", 2)]}, "unsigned term"),
    ],
)
def test_invalid_declarations_fail_the_run(spark, made, problem):
    assert results(spark, [made])["r"].problem == problem
    with pytest.raises(identity.InvalidDeclaration):
        identity.run(*frames(spark, [made], FACTS))


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (dict(sourceLocator=""), "missing provenance"), (dict(artifactSha256="xyz"), "malformed digest"), (dict(nativeCellLocator='{"kind":"dataset_cell","rowId":"a"}'), "noncanonical cell locator"),
        (dict(nativeCellLocator='{"field":"v","kind":"dataset_cell","rowId":"b"}'), "same cell twice"), (dict(value="1e5"), "inexact number"),
    ],
)
def test_invalid_facts_fail_the_run(spark, change, problem):
    assert results(spark, [rule("r", ["a", "b"], ["t"])], [fact("a", "68201.98") | change, *FACTS[1:]])["r"].problem == problem


def test_missing_fact_comes_before_bad_provenance(spark):
    got = results(spark, [rule("r", ["a", "zzz"], ["t"])], [fact("a", "1", artifactSha256="xyz"), *FACTS[1:]])["r"]
    assert (got.status, got.problem) == ("insufficient_evidence", None)


def test_money_needs_a_basis(spark):
    money = dict(currency="CAD", financialBasisId="b", financialBasisVerified=True)
    facts = [fact("a", "5", **money), fact("t", "5.0", "printed_total", **money)]
    made = rule("r", ["a"], ["t"], mode="monetary_comparison", financialBasisId="b")
    got = results(spark, [made], facts)["r"]
    assert (got.status, got.residual, got.currency) == ("explained", "0.0", "CAD")
    for change, reason in ((dict(currency=None), "unknown currency"), (dict(financialBasisId="c"), "undeclared financial basis"), (dict(financialBasisVerified=False), "unverified financial basis")):
        assert results(spark, [made], [facts[0] | change, facts[1]])["r"].reasons == [reason]


def test_more_digits_than_the_jvm_holds(spark):
    a = "1" + "0" * 60
    facts = [fact("a", a + ".5"), fact("t", a, "printed_total")]
    got = results(spark, [rule("r", ["a"], ["t"])], facts)["r"]
    assert (got.status, got.residual) == ("flagged_unreviewed", "0.5")


def test_no_rules(spark):
    assert results(spark, []) == {}


def test_comparison(spark):
    period = ("2024-04-01", "2025-03-31", "2024-25", None)
    ddl = "struct<metric:string,currency:string,unit:string,measureType:string,accountingBasis:string,reportingPerimeter:string,entity:string,jurisdiction:string,multiplier:long,stage:string,rawValue:string,period:struct<start:string,end:string,label:string,asOf:string>>"
    f = lambda stage, value, **m: tuple((dict(metric="m", currency="CAD", unit="CAD_thousands", measureType="flow", accountingBasis="b", reportingPerimeter="p", entity="e", jurisdiction="j", multiplier=1000, stage=stage, rawValue=value, period=period) | m).values())
    pairs = [
        (f("original_estimate", "17770390"), f("amended_estimate", "17823982")), (f("amended_estimate", "1"), f("original_estimate", "2")),
        (f("original_estimate", "1", unit="CAD_millions"), f("amended_estimate", "2")), (f("original_estimate", None), f("amended_estimate", "2")), (f("original_estimate", "1", entity=None), f("amended_estimate", "2", entity=None)),
    ]
    df = spark.createDataFrame(pairs, f"a {ddl}, b {ddl}")
    got = [(r.comparable, r.difference) for r in identity.compare(df).collect()]
    assert got == [(True, "53592.000000"), (False, None), (False, None), (True, None), (False, None)]
    assert [r.comparable for r in identity.compare(df, strict_stage=False).collect()] == [True, True, False, True, False]


def test_a_locator_is_read_once(spark):
    """One reading for its values, one for its keys, one for their kinds, where the fact is; nothing of it travels to the rules."""
    text = identity.evaluate(spark.createDataFrame([], identity.RULES), spark.createDataFrame([], identity.FACTS))._jdf.queryExecution().analyzed().toString()
    assert [text.count(f"{f}(") for f in ("get_json_object", "json_tuple", "json_object_keys", "try_parse_json")] == [0, 1, 1, 1]


def test_no_facts_go_through_the_driver(spark):
    """Estimates from files say little of texts made on the way, so neither facts nor what is packed of them nor a schedule's rows are broadcast, however small they look."""
    records = freeze(spark.createDataFrame([("s", 1, "a", "1.5", "7", 1, SHA, SHA)], "schedule string, position int, id string, amount string, page string, row int, artifact string, source string"))
    totals = freeze(spark.createDataFrame([("s", "1.5", "8", SHA, SHA)], "schedule string, amount string, page string, artifact string, source string"))
    facts, rules = adapters.schedules(records, totals, "dollars")
    judged = identity.evaluate(rules, facts)
    for df, joins in ((identity.evaluate(*map(freeze, frames(spark, [rule("r", ["a", "b"], ["t"])], FACTS))), 2), (rules, 1), (judged, 4)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("SortMergeJoin"), plan.count("Broadcast")) == (joins, 0)
    assert [(r.rule_id, r.status, r.left_value) for r in judged.collect()] == [("s-total-v1", "explained", "1.5")]
