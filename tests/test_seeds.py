"""Research seeds: what follows from an id, and that one fault refuses the whole."""

import pytest

from tallyspark.operators import seeds
from tallyspark.operators.gates import Refused

DDL = "position long, candidate_id string, source_id string, status string, unit string, verified_value string, source_locator string"
GOOD = (1, "original-2026-27-departmental-expenses", "d1", seeds.REVIEWED, "CAD_thousands", "17000000", "p. 3")


def build(spark, *rows, url="https://a.b/c"):
    documents = spark.createDataFrame([("d1", "doc-1", "Estimates", url), ("d2", "doc-2", "Accounts", "https://a.b/d")], "research_id string, id string, title string, url string")
    return seeds.research_facts(spark.createDataFrame(list(rows), DDL), documents)


def test_what_follows_from_an_id(spark):
    rows = [GOOD, (2, "actual-2025-26-net-debt", "d2", seeds.REVIEWED, "CAD_millions", "-1.5e3", "s"), (3, "capital-2026-27-roads", "d1", seeds.REVIEWED, "CAD_millions", "1", "s"), (1000, "adjusted_estimate-2025-26-a-b", "d1", seeds.REVIEWED, "CAD_thousands", "0", "s")]
    got = {r.id: r for r in build(spark, *rows).collect()}
    a, b, c, d = (got[f"finance-{n}"] for n in ("001", "002", "003", "1000"))
    assert (a.stage, a.metric, a.title, a.evidence_title, a.multiplier, a.measure_type) == ("original_estimate", "departmental_expenses", "Departmental expenses", "Estimates — departmental expenses", 1000, "flow")
    assert tuple(a.period) == ("2026-04-01", "2027-03-31", "2026-27", None) and a.basis == seeds.BASES[2] and a.source_id == "doc-1" and a.evidence_id == "evidence-001"
    assert tuple(b.period) == ("2025-04-01", "2026-03-31", "2025-26", "2026-03-31") and (b.measure_type, b.basis, b.perimeter, b.raw_value) == ("stock", seeds.BASES[0], seeds.PERIMETERS[0], "-1.5e3")
    assert (c.stage, c.basis, c.perimeter) == ("capital_plan", seeds.BASES[1], seeds.PERIMETERS[1]) and d.stage == "adjusted_estimate"


@pytest.mark.parametrize(("at", "value"), [(1, "original-2024-25-x"), (1, "revised-2026-27-x"), (1, "departmental"), (2, "d9"), (3, "draft"), (4, "CAD"), (5, "NaN"), (5, "n/a"), (5, None), (1, None)])
def test_one_fault_refuses_the_seed(spark, at, value):
    bad = list(GOOD)
    bad[0], bad[1] = 2, "amended-2026-27-y"
    bad[at] = value
    with pytest.raises(Refused):
        build(spark, GOOD, tuple(bad))


def test_repeats_and_addresses(spark):
    for rows, url in (([GOOD, (2, *GOOD[1:])], "https://a.b/c"), ([GOOD], "http://a.b/c")):
        with pytest.raises(Refused):
            build(spark, *rows, url=url)


def test_inventory(spark):
    values = ["g", "j", "t", "https://a.b/", "f", "u", "geo", "acc", "P0", "lim", "claim", "weekly"]
    rows = lambda *v: spark.createDataFrame([(i + 1, i + 5, x) for i, x in enumerate(v)], "position long, row long, values array<string>")
    got = seeds.inventory_sources(rows(values)).first()
    assert (got.id, got.inventory_id, got.inventory_row, got.title, got.cadence, got.priority) == ("guide-001", "SI001", 5, "t", "weekly", "P0")
    for bad in (values[:11], values + ["x"], [*values[:3], "http://a.b/", *values[4:]]):
        with pytest.raises(Refused):
            seeds.inventory_sources(rows(values, bad))


def test_repeated_ids_are_counted_by_kind(spark, tmp_path):
    """A stock that repeats and a name that repeats are a row each, as in the query's SQL."""
    from tallyspark import plans

    part = [(1, "plum", "Brand#12", "SMALL TIN", 50), (2, "fig", "Brand#12", "SMALL TIN", 50), (3, "pear", "Brand#12", "SMALL TIN", 11), (4, "pear", "Brand#12", "SMALL TIN", 11), (5, "kiwi", "Brand#12", "SMALL TIN", 1)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.rule_id, r.n) for r in plans.QUERIES["research_seed_faults"](spark, str(tmp_path)).collect())
    assert got == [("candidate_once", 1), ("candidate_once", 1), ("observation", 2)]
