import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import catalog, diff, joins, reconcile, search

AWARD = "id string, source_row_id string, tender_id string, publisher string, supplier string, awarded date, categories map<string,string>"


def awards(spark):
    d = datetime.date
    yes, no = {"construction": "N", "goods": "Y", "service": "N"}, {"construction": "N", "goods": "N", "service": "Y"}
    return spark.createDataFrame(
        [("z", "1", "T1", "Harbour", None, d(2024, 5, 1), yes), ("a", "2", "T2", "Harbour", "Acme", d(2024, 5, 1), no), ("old", "3", "T3", "Town", None, d(2020, 1, 1), yes), ("missing", "4", "T4", "Town", "Acme", None, yes)], AWARD
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_order_and_filters(spark):
    assert ids(search.observations(awards(spark))) == ["a", "z", "old", "missing"]
    assert ids(search.observations(awards(spark), "harbour t1")) == ["z"]
    assert ids(search.observations(awards(spark), low="2020-01-01", high="2024-04-30")) == ["old"]
    assert ids(search.observations(awards(spark), supplier="ACME")) == ["a", "missing"]
    assert ids(search.observations(awards(spark), category="goods", entity="town")) == ["old", "missing"]


@pytest.mark.parametrize("bad", [dict(low="2024-02-30"), dict(low="2024-1-1"), dict(low="2024-02-01", high="2024-01-01"), dict(category="boats")])
def test_arguments_are_checked_before_anything_is_read(bad):
    with pytest.raises(ValueError):
        search.observations(None, **bad)


def test_pages(spark):
    assert [search.page_of(30, p, 12) for p in (-1, float("nan"), float("inf"), 0, 1e30, 2, 2.5, "x", 3)] == [(1, 3), (1, 3), (1, 3), (1, 3), (1, 3), (2, 3), (1, 3), (1, 3), (3, 3)]
    assert search.page_of(0, 5, 12) == (1, 1)
    for size in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            search.page_of(1, 1, size)
    rows, current, pages, total = search.page(search.observations(awards(spark)), 9, 3)
    assert (ids(rows), current, pages, total) == (["missing"], 2, 2, 4)


def test_one_record(spark):
    assert ids(search.exactly_one(awards(spark), F.col("id") == "z")) == ["z"]
    for c in (F.col("id") == "none", F.col("publisher") == "Town"):
        with pytest.raises(LookupError):
            search.exactly_one(awards(spark), c)


def test_dictionary_order(spark):
    df = spark.createDataFrame([(d, "P", i) for i, d in (("b", 1), ("A1", 1), ("a", 1), ("A_1", 1), ("B", 2))], "payment_date int, program_code string, id string")
    assert ids(search.payments_order(df)) == ["B", "a", "A_1", "A1", "b"]


def test_labels_keep_unmatched_rows_and_faults_are_found(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None)], "id string, row string")
    labels = spark.createDataFrame([("1", "x", "L")], "id string, row string, label string")
    assert {(r.id, r.label) for r in joins.label(rows, labels, ["id"], ["label"]).collect()} == {("1", "L"), ("2", None), ("3", None)}
    bad = spark.createDataFrame([("1", "x"), ("1", "x"), ("9", "x"), ("2", "other"), ("3", None)], "id string, row string")
    assert {(r.fault, r.key) for r in joins.label_faults(rows, bad, ["id"], ["row"]).collect()} == {("duplicate", "1"), ("unmatched", "9"), ("differs", "2"), ("differs", "3")}


def test_unknown_never_equals_unknown(spark):
    left = spark.createDataFrame([("a", None, 1), ("b", "x", 1), ("c", "x", 1)], "id string, unit string, n int")
    right = spark.createDataFrame([("a", None, 1), ("b", "x", 1)], "id string, unit string, n int")
    assert {(r.id, r.agrees) for r in joins.linked(left, right, ["id"], ["unit", "n"]).collect()} == {("a", False), ("b", True), ("c", False)}
    arrays = spark.createDataFrame([([1, 2], [1, 2]), ([1, 2], [2, 1]), ([1, None], [1, None])], "a array<int>, b array<int>")
    assert [r[0] for r in arrays.select(joins.same_array(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_populations(spark):
    members = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "k string, id int")
    for listed, equal in (([1, 2], True), ([1], False), ([1, 2, 2], False), ([1, 3], False), ([], False)):
        claims = spark.createDataFrame([("k", listed)], "k string, ids array<int>")
        assert joins.same_population(claims, members, ["k"], "ids", "id").first().equal is equal


def test_pins(spark):
    children = spark.createDataFrame([("c1", "s1", "r"), ("c2", "s2", "r"), ("c3", None, "r")], "id string, parent_sha string, rec string")
    parents = spark.createDataFrame([("s1", "r")], "sha string, record_id string")
    assert ids(joins.pinned(children, parents, record="rec")) == ["c1"]


def test_sums_refuse_missing_parts_and_undeclared_scopes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", None)], "g string, v int")
    assert {(r.g, r.total) for r in reconcile.exact_total(df, ["g"], F.col("v")).collect()} == {("a", 3), ("b", None)}
    assert {(r.g, r.total) for r in reconcile.Measure("v", ["g"]).total(df, "g").collect()} == {("a", 3), ("b", None)}
    for m, by in ((reconcile.Measure("v"), ["g"]), (reconcile.Measure("v", ["g"]), [])):
        with pytest.raises(reconcile.NotAdditive):
            m.total(df, *by)


def test_residuals(spark):
    parts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", None)], "k string, v int")
    totals = spark.createDataFrame([("a", 3), ("b", 5), ("c", 1), ("d", 1)], "k string, t int")
    got = {r.k: (r.residual, r.status) for r in reconcile.residuals(parts, totals, ["k"], "v", "t").collect()}
    assert got == {"a": (0, "explained"), "b": (-4, "flagged_unreviewed"), "c": (None, "insufficient_evidence"), "d": (None, "insufficient_evidence")}


def test_changes(spark):
    kind = "year string, k string, v string"
    old = spark.createDataFrame([("y", "a", "1"), ("y", "b", "1"), ("y", "c", None)], kind)
    same = diff.changes(old, old, ["year", "k"], "v")
    assert same.where("change <> 'same'").count() == 0
    new = spark.createDataFrame([("y", "a", "2"), ("z", "d", "1"), ("y", "c", "0")], kind)
    cover = {r.year: r.asDict() for r in diff.coverage(diff.changes(old, new, ["year", "k"], "v"), "year", ["year", "k"]).collect()}
    assert (cover["y"]["changed_keys"], cover["y"]["removed_keys"], cover["y"]["n_old"], cover["y"]["n_new"]) == ("y|a,y|c", "y|b", 3, 2)
    assert cover["z"]["added_keys"] == "z|d"


def test_conflicts_keep_every_version(spark):
    rows = spark.createDataFrame([("s1", "p", "file", "a"), ("s2", "p", "file", "b"), ("s3", "p", "file", "b"), ("s1", "q", "file", "a"), ("s2", "q", "file", "a")], "snapshot string, path string, kind string, sha string")
    got = diff.conflicts(rows).collect()
    assert [(r.path, [tuple(v) for v in r.versions]) for r in got] == [("p", [("s1", "file", "a"), ("s2", "file", "b"), ("s3", "file", "b")])]


def test_urls_in_bundles(spark):
    body = '{"url":"https://a/x#y","n":[{"sourceURL":"https://b"},{"url":"http://c"}],"sources":[{"url":"https://skipped"}],"u":{"url":"https://a/x"}}'
    nested = '{"sources":[{"tags":["x"],"url":"https://s1"}],"a":{"sources":{"url":"https://s2"},"url":"https:\\/\\/c\\/d"},"sourceURL":["https://no"],"b":[[{"url":"https://e"}]]}'
    df = spark.createDataFrame([("i", body), ("j", "{}"), ("k", None), ("l", nested), ("m", "{"), ("n", '{"url":{"url":"https://deep"}}')], "id string, body string")
    assert {r.id: r.urls for r in catalog.https_urls(df).collect()} == {"i": ["https://a/x", "https://b"], "j": [], "k": None, "l": ["https://c/d", "https://e"], "m": [], "n": ["https://deep"]}


def test_public_cases(spark):
    pub = "struct<allowed:boolean,consequentialAllegation:boolean,reviewType:string,reviewId:string,reviewedOn:string>"
    ddl = f"id string, publication {pub}, status string, classification string, fact_ids array<string>, evidence_ids array<string>"
    good = ("1", (True, False, "neutral_source_comparison", "r", "2026-01-01"), "documented_comparison", "calculated_source_comparison", ["f"], ["e"])
    bad = [("2", (True, True, *good[1][2:]), *good[2:]), ("3", (True, False, "neutral_source_comparison", None, "2026-01-01"), *good[2:]), ("4", *good[1:4], [], ["e"]), ("5", None, *good[2:])]
    df = spark.createDataFrame([good, *bad], ddl)
    assert ids(df.where(catalog.public_case(df))) == ["1"]
