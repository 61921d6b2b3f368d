import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import collections as suites
from tallyspark.operators import gates, journal, readiness

SETS, FILES, PINS = "set string, value string", "path string, kind string, bytes long, sha string, body string", "path string, sha string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sets_are_compared_with_the_kind_of_their_values(spark):
    expected = [("w", '"verify.yml"'), ("n", "200"), ("o", '{"a": 1, "b": 2}'), (None, "1"), ("gone", "1")]
    same = [("w", ' "verify.yml"'), ("n", "200"), ("o", '{"b":2,"a":1}'), (None, "1"), ("gone", "1")]
    run = lambda rows: {tuple(r) for r in readiness.set_issues(spark.createDataFrame(rows, SETS), spark.createDataFrame(expected, SETS)).collect()}
    assert run(same) == set()
    assert run(same[:1] + [("n", '"200"')] + same[2:]) == {("n", "200", "missing"), ("n", '"200"', "unexpected")}
    assert run([*same, ("w", '"nightly.yml"')]) == {("w", '"nightly.yml"', "unexpected")}
    assert run([*same, same[1]]) == {("n", "200", "repeated")}
    assert run(same[:-1]) == {("gone", "1", "missing")}
    assert run([*same, ("w", None), ("w", "verify.yml"), ("w", '{"a":1,"a":1}')]) == {("w", None, "not a value"), ("w", "verify.yml", "not a value"), ("w", '{"a":1,"a":1}', "not a value")}
    assert run([]) == {("w", '"verify.yml"', "missing"), ("n", "200", "missing"), ("o", '{"a":1,"b":2}', "missing"), (None, "1", "missing"), ("gone", "1", "missing")}
    nothing = spark.createDataFrame([], SETS)
    assert readiness.set_issues(nothing, nothing).isEmpty()


def checkout(**changed):
    manifest = json.dumps({"files": {"a.py": sha("A"), "b.py": sha("B")}})
    bodies = {"p/MANIFEST.json": manifest, "p/a.py": "A", "p/b.py": "B", "data.json": "{}"} | changed
    return [(path, "file", len(body), sha(body), body) for path, body in bodies.items() if body is not None], [("p/MANIFEST.json", sha(manifest)), ("data.json", sha("{}"))]


def drift(spark, files, pins):
    files, pins = spark.createDataFrame(files, FILES), spark.createDataFrame(pins, PINS)
    manifests = spark.createDataFrame([("p/MANIFEST.json", "p")], "path string, base string")
    return {tuple(r) for r in readiness.pin_issues(files, readiness.manifest_pins(files, pins, manifests)).collect()}


def test_pins_follow_the_manifest_only_if_it_is_the_pinned_one(spark):
    lost, changed = "missing, not a regular file or too large", "pinned bytes changed"
    files, pins = checkout()
    assert drift(spark, files, pins) == set()
    assert drift(spark, checkout(**{"p/b.py": "other"})[0], pins) == {("p/b.py", changed)}
    assert drift(spark, checkout(**{"p/b.py": None})[0], pins) == {("p/b.py", lost)}
    assert drift(spark, checkout(**{"p/MANIFEST.json": '{"files": {}}', "p/a.py": "other"})[0], pins) == {("p/MANIFEST.json", changed)}
    assert drift(spark, [(*f[:1], "link", *f[2:]) if f[0] == "data.json" else f for f in files], pins) == {("data.json", lost)}
    assert drift(spark, [(*f[:2], (8 << 20) + 1, *f[3:]) if f[0] == "p/a.py" else f for f in files], pins) == {("p/a.py", lost)}
    assert drift(spark, [*files, files[1]], pins) == {("p/a.py", lost)}
    assert drift(spark, files, [*pins, ("data.json", sha("x")), ("p/a.py", None)]) == {("data.json", changed), ("p/a.py", changed)}


@pytest.mark.parametrize("path", ["/etc/passwd", "../data.json", "p/../data.json", "./data.json", "p//a.py", "p/a.py/", "", "."])
def test_pins_stay_inside(spark, path):
    files, pins = checkout()
    found = (path, "file", 1, sha("A"), "A")
    assert drift(spark, [*files, found], [*pins, (path, sha("A"))]) == {(path, "invalid path")}


def test_flags_are_off_only_if_false(spark):
    values = {"false": None, " false ": None, "true": "not disabled", "0": "not disabled", '"false"': "not disabled", "null": "not disabled", "False": "not disabled"}
    rows = [(f"f{i}", "ON", v) for i, v in enumerate(values)] + [("twice", "ON", "false")] * 2 + [("other", "OFF", "false")]
    required = [(f"f{i}", "ON") for i in range(len(values))] + [("twice", "ON"), ("other", "ON")]
    got = {r.path: r.reason for r in readiness.flag_issues(spark.createDataFrame(rows, "path string, name string, value string"), spark.createDataFrame(required, "path string, name string")).collect()}
    assert got == {f"f{i}": why for i, why in enumerate(values.values()) if why} | {"twice": "not assigned exactly once", "other": "not assigned exactly once"}


BASE = json.dumps({"source": {"datasetId": "d", "capturedAt": "2024-01-01T00:00:00+00:00"}, "records": [1, 2]})
NAMES = ("baseline differs", "review differs")


def bind(spark, base=BASE, review=None, says=None, copies=1):
    review = json.dumps({"status": "accepted", "bundleSha256": sha(BASE)} | (review or {}))
    b = spark.createDataFrame([("n", base)] * copies, "name string, body string")
    r = spark.createDataFrame([("n", review)], "name string, body string")
    d = spark.createDataFrame([("n", *(says or (sha(base), sha(review))))], "name string, baseline_sha string, review_sha string")
    problems = readiness.binding_problems(b, r, d)
    return problems.first().problems, readiness.provenance(b, problems).collect()


def test_baseline_review_and_declaration_are_bound(spark):
    problems, origin = bind(spark)
    assert problems == [] and [(r.dataset, r.observations, r.baseline_sha, str(r.floor)) for r in origin] == [("d", 2, sha(BASE), "2024-01-08 00:00:00")]
    assert bind(spark, review={"status": "rejected"}) == (["review is not accepted"], [])
    assert bind(spark, review={"status": ["accepted"]}) == (["review is not accepted"], [])
    assert bind(spark, review={"bundleSha256": sha("x")}) == (["review is of other bytes"], [])
    assert bind(spark, base=BASE + " ") == (["review is of other bytes"], [])
    assert bind(spark, says=("x", None)) == ([f"declared {n}" for n in NAMES], [])
    assert bind(spark, copies=2) == (["not one baseline"], [])
    odd = BASE.replace("+00:00", "")
    assert bind(spark, base=odd, review={"bundleSha256": sha(odd)}) == (["unknown time of retrieval"], [])
    none = spark.createDataFrame([], "name string, body string")
    alone = readiness.binding_problems(spark.createDataFrame([("n", "not json")], "name string, body string"), none, spark.createDataFrame([], "name string, baseline_sha string, review_sha string"))
    assert alone.first().problems == ["not one review", "not one declaration", "review is not accepted", "review is of other bytes", *[f"declared {n}" for n in NAMES], "unknown time of retrieval"]


def test_holds_keep_their_words(spark):
    sources = spark.createDataFrame([("a", "u", ["No licence", "ACCESS HOLD since May", None]), ("b", "v", ["Open"]), ("c", "w", None), ("d", "x", [])], "id string, url string, limitations array<string>")
    assert [tuple(r) for r in readiness.retained_holds(sources).collect()] == [("a", "u", ["ACCESS HOLD since May"])]


def test_a_report_authorises_nothing(spark):
    one, none = spark.range(2), spark.range(0)
    assert tuple(readiness.report(pins=none, sets=none).first()) == (readiness.INACTIVE, True, False, False, 0, 0)
    assert tuple(readiness.report(pins=one, sets=none).first()) == (readiness.DRIFT, False, False, False, 2, 0)


def test_receipts_tell_when_they_were_completed(spark):
    times = [("2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z"), ("2024-01-01T00:00:00Z", None), ("2024-01-01T00:00:00Z", "2024-01-01T00:00:01"), (None, "2024-01-01T00:00:01Z")]
    rows = [(f"s{i}", f"attempts/1/robots.{kind}.json", "file", 1, "x", json.dumps({"attemptedAt": a, "completedAt": z})) for kind in ("receipt", "attempt") for i, (a, z) in enumerate(times)]
    found = journal.findings(spark.createDataFrame(rows, "snapshot string, path string, kind string, bytes long, sha string, body string")).where("code = 'unknown_request_time'")
    assert {(r.snapshot, r.path.split(".")[1]) for r in found.collect()} == {("s1", "receipt"), ("s2", "receipt"), ("s3", "receipt"), ("s3", "attempt")}


CELL = "id string, table string, section string, label string, presence string, pdf_page int, source_pdf_sha string, latest_forecast_claim boolean"


def cells(spark, **change):
    rows = [dict(id=str(i), table=t, section="s", label=str(i // 3), presence="source_dash" if i == 5 else "present", pdf_page=p, source_pdf_sha="x", latest_forecast_claim=False) for i, (t, p) in enumerate([("2.1", 2)] * 3 + [("2.2", 3), ("2.2", 4), ("2.2", 4)])]
    return spark.createDataFrame([tuple((r | change if i == 0 else r).values()) for i, r in enumerate(rows)], CELL)


@pytest.mark.parametrize(
    ("change", "rules"),
    [
        ({}, set()), ({"pdf_page": 3}, {"page"}), ({"table": "2.2"}, {"page", "lines"}), ({"table": "9"}, {"page", "lines"}), ({"pdf_page": None}, {"page"}), ({"table": None}, {"page", "lines"}), ({"source_pdf_sha": "y"}, {"same_pdf"}),
        ({"latest_forecast_claim": True}, {"not_latest_forecast_claim"}), ({"latest_forecast_claim": None}, {"not_latest_forecast_claim"}), ({"presence": "blank"}, {"present"}), ({"label": "9"}, {"lines"}),
    ],
)
def test_budget_pages(spark, change, rules):
    pages = spark.createDataFrame([("2.1", 2, 2), ("2.2", 3, 5), ("2.2", 3, 5)], "table string, first_page int, last_page int")
    suite = suites.budget_pages(pages, "x", slots=6, present=5, lines=2)
    assert {v.rule_id for v in gates.violations(cells(spark, **change), suite).collect()} == rules
    assert {v.rule_id for v in gates.violations(cells(spark).limit(0), suite).collect()} == {"slots", "present", "lines"}


def test_ranges_that_overlap(spark):
    rows = [("d", "a", 1, 9), ("d", "b", 2, 3), ("d", "c", 5, 6), ("d", "e", 10, 12), ("d", "f", 12, 14), ("g", "a", 1, 2), ("g", "b", 3, 3), ("g", "c", 5, 4), ("g", "e", None, 8), ("h", "a", 1, 1), ("h", "b", 1, 1)]
    ranges = spark.createDataFrame(rows, "document string, id string, low int, high int").withColumn("__reached", F.lit(0))
    found = gates.disjoint(ranges, ["document"], "low", "high")
    assert found.columns == ranges.columns
    assert {(r.document, r.id) for r in found.collect()} == {("d", "b"), ("d", "c"), ("d", "f"), ("g", "c"), ("g", "e"), ("h", "b")}
