"""Equations against declared graphs, and JSON values field by field."""

import json

from pyspark.sql import functions as F

from tallyspark.functions import hashing
from tallyspark.operators import catalog, reconcile

GRAPH = [("net", ["revenue", "expense"], "surplus"), ("cash", ["opening", "change"], "closing")]
RECORDS = [(f"{k}-{y}", k, y) for k in ("revenue", "expense", "surplus", "opening", "change", "closing", "note") for y in ("2024", "2025")]


def faults(spark, *equations):
    eq = spark.createDataFrame([(f"e{i}", *e) for i, e in enumerate(equations)], "equation_id string, kind string, fiscal_year string, inputs array<string>, output string")
    got = reconcile.graph_faults(eq, spark.createDataFrame(RECORDS, "id string, key string, fiscal_year string"), spark.createDataFrame(GRAPH, "kind string, inputs array<string>, output string"))
    out = {}
    for r in got.orderBy("position").collect():
        out.setdefault(r.equation_id, []).append((r.position, r.fault))
    return [out.get(f"e{i}", []) for i in range(len(equations))]


def test_equations_against_a_graph(spark):
    r, e, s = "revenue-2025", "expense-2025", "surplus-2025"
    cases = {
        ("net", "2025", (r, e), s): [], ("net", "2025", (e, r), s): [(1, "swapped"), (2, "swapped")], ("net", "2025", (r, "note-2025"), s): [(2, "other label")], ("net", "2025", (r, "expense-2024"), s): [(2, "other year")], ("net", "2024", (r, e), s): [(0, "other year"), (1, "other year"), (2, "other year")],
        ("net", "2025", (r,), s): [(2, "missing input")], ("net", "2025", (r, e, "note-2025"), s): [(3, "extra input")], ("net", "2025", (r, "gone"), s): [(2, "unknown record")], ("net", "2025", (r, r), s): [(1, "repeated input"), (2, "repeated input")],
        ("other", "2025", (r, e), s): [(0, "no graph")], ("net", "2025", (r, e), "closing-2025"): [(0, "other label")], ("cash", "2024", ("opening-2024", "change-2024"), "closing-2024"): [],
    }
    assert faults(spark, *[(k, y, list(i), o) for k, y, i, o in cases]) == list(cases.values())


def test_no_equations(spark):
    assert faults(spark) == []


def test_values_field_by_field(spark):
    base = {"a": 1, "b": [1, {"c": None}], "d/e~": "x", "t": True}
    cases = [(base, dict(reversed(base.items())), []), (base, base | {"a": 1.0}, []), (base, base | {"t": 1}, ["/t"]), (base, base | {"b": [1, {"c": 0}, 3], "z": 1}, ["/b/1/c", "/b/2", "/z"]), (base, base | {"d/e~": "y"}, ["/d~1e~0"]), ({"a": "1"}, {"a": 1}, ["/a"]), ([1, 2], {"0": 1}, [""]), ({"a": None}, {}, ["/a"])]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b, _) in enumerate(cases)] + [(97, "[" * 100_000 + "]" * 100_000, "1"), (98, "x", "x"), (99, None, "1")]
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", hashing.differing()(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [d for *_, d in cases] + [[""], [""], None]


def test_directory_rows_against_bundles(spark):
    bundles = spark.createDataFrame([(i, json.dumps({"title": "T " + i, "sourceURL": "https://a.b/" + i, "records": [1, 2]}), "rows", "#/" + i, "s") for i in "pqr"], "id string, body string, count_unit string, route string, scope string")
    receipts = spark.createDataFrame([(i, "e", "2026-01-02") for i in "pqr"], "id string, evidence_id string, reviewed_on string")
    entries = catalog.directory_entry(bundles, receipts)
    found = {r.id: json.loads(r.body) for r in entries.collect()}
    assert found["p"]["count"] == 2 and found["p"]["sourceURLs"] == ["https://a.b/p"] and len(found["p"]) == 15
    for field, value in found["p"].items():
        changed = {**found["p"], field: [value] if not isinstance(value, list) else None}
        rows = spark.createDataFrame([("p", json.dumps(changed)), ("q", json.dumps(found["q"])), ("x", "{}")], "id string, body string")
        if field in ("id", "count", "sourceURLs", "completeSourceCoverage"):
            assert sorted((r.id, r.path) for r in catalog.directory_differences(rows, entries).collect()) == [("p", "/" + field), ("r", ""), ("x", "")]
