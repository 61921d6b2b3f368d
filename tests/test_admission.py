"""Admission: what is handed out are the bytes that were judged; patterns take linear work; allowlists recurse."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import hashing, text
from tallyspark.operators import gates, joins, robots
from tallyspark.operators.gates import Refused
from tallyspark.sources import frozen, pinned, sinks


def put(folder, name, body):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(body)
    return hashlib.sha256(body.encode()).hexdigest(), len(body)


def test_files_that_change_after_admission_change_nothing(spark, tmp_path):
    sha, n = put(tmp_path / "in", "a.json", '{"x":1}')
    pins = spark.createDataFrame([("a.json", sha, n)], "name string, sha string, bytes long")
    got = pinned.verified(pinned.files(spark, str(tmp_path / "in")), pins)
    put(tmp_path / "in", "a.json", '{"x":2}')
    assert [r.text for r in got.collect()] == ['{"x":1}']
    with pytest.raises(Refused):
        pinned.verified(pinned.files(spark, str(tmp_path / "in")), pins)


def test_shards_that_change_after_admission_change_nothing(spark, tmp_path):
    body = json.dumps({"schemaVersion": "v1", "records": [{"id": "1"}, {"id": "2"}]})
    sha, n = put(tmp_path / "in", "rows-001.json", body)
    manifest = spark.createDataFrame([("rows-001.json", sha, n, 2, 2)], "path string, sha string, bytes long, records int, record_count int")
    rows = pinned.load_shards(spark, str(tmp_path / "in"), manifest, "id string", version="v1")
    put(tmp_path / "in", "rows-001.json", body.replace('"1"', '"9"'))
    assert sorted(r.id for r in rows.collect()) == ["1", "2"]
    put(tmp_path / "in", "rows-001.json", body)
    with pytest.raises(Refused, match="version"):
        pinned.load_shards(spark, str(tmp_path / "in"), manifest, "id string", version="v2")


def test_files_over_the_bound_are_listed_and_not_read(spark, tmp_path):
    put(tmp_path / "in", "big.json", "x" * 100)
    put(tmp_path / "in", "small.json", "y")
    found = pinned.files(spark, str(tmp_path / "in"), most=50)
    assert {(r.path.rsplit("/", 1)[-1], r.bytes, r.body is None, r.sha is None) for r in found.collect()} == {("big.json", 100, True, True), ("small.json", 1, False, False)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,50)" in plan and plan.count("content#") > 0


def test_snapshots_are_loaded_once(spark):
    held, calls = frozen.Snapshots(), []
    load = lambda: calls.append(1) or spark.range(3)
    assert held.get("pin", load).count() == held.get("pin", load).count() == 3 and len(calls) == 1
    with pytest.raises(Refused):
        held.get("other", lambda: gates.admit(spark.range(1), [gates.row("never", F.lit(False))], "id"))


def decide(spark, body, url):
    policies = spark.createDataFrame([(1, body.encode())], "policy_id int, body binary")
    requests = spark.createDataFrame([(1, 1, url, "bot")], "request_id int, policy_id int, url string, token string")
    return robots.decide(policies, requests).first()


@pytest.mark.parametrize(
    ("rule", "path", "hit"),
    [
        ("/*a*a*a*a*b", "/" + "a" * 8_000, False), ("/*a*a*a*a*b", "/" + "a" * 200 + "b", True), ("/a*b$", "/axxb", True), ("/a*b$", "/axbx", False), ("/a*a$", "/a", False), ("/a$", "/a", True), ("/a$", "/ab", False),
        ("/*.php$", "/x.php", True), ("/*.php$", "/x.php5", False), ("/*b*b$", "/ab", False), ("/*b*b$", "/abb", True), ("*", "/x", True), ("/*2F", "/a%2F", False), ("/*%2F", "/a%2Fb", True), ("/a**c", "/abc", True), ("/ab*ba$", "/aba", False),
    ],
)
def test_patterns(spark, rule, path, hit):
    began = time.time()
    got = decide(spark, f"User-agent: *\nDisallow: {rule}\n", f"https://h.example{path}")
    assert got.status == ("disallow" if hit else "allow") and time.time() - began < 20


def test_public_fields_by_path(spark):
    fields = {"root": ["a", "facts"], "root.facts[]": ["id", "period"], "root.facts[].period": ["start"]}
    rows = ['{"a":1,"facts":[{"id":1,"period":{"start":"x"}}]}', '{"a":{"b":1}}', '{"facts":[{"id":1,"note":2},{"period":{"end":1}}],"z":1}', "{", None, '{"a":[[{"q":1}]]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, body string").select("i", hashing.unapproved(F.col("body"), fields).alias("bad"))
    assert {r.i: r.bad for r in df.collect()} == {0: [], 1: ["root.a"], 2: ["root.facts[].note", "root.facts[].period.end", "root.z"], 3: ["root"], 4: None, 5: ["root.a[][]"]}


def test_keys_that_differ_look_different(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a|b", "c"), ("a", "b|c"), ("a", "b|c")], "x string, y string").withColumn("id", F.lit(1))
    assert gates.violations(df, [gates.key("k", "x", "y")]).select("key").distinct().count() == 2


def test_labels_that_repeat_are_refused(spark):
    rows, labels = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="more than one label for a"):
        joins.label(rows, labels, ["k"], ["v"]).collect()


def test_release_by_relative_path_and_siblings_of_inputs(spark, tmp_path):
    put(tmp_path / "out", "a.json", "{}")
    put(tmp_path / "out" / "b", "a.json", "{}")
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert sinks.release(spark, str(tmp_path / "out"), paths("a.json", "b/a.json")).count() == 2
    with pytest.raises(ValueError):
        sinks.release(spark, str(tmp_path / "out"), paths("a.json"))
    assert sinks.check_target("/in/put2", ["/in/put"]) == "/in/put2"
    with pytest.raises(ValueError):
        sinks.check_target("/in/put/x", ["/in/put"])


def test_compatibility_form_of_ascii_and_other_texts(spark):
    df = spark.createDataFrame([("ABC",), ("\ufb01n \u212b",), (None,), ("",)], "t string").select("t", text.compatible(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == {"ABC": "abc", "\ufb01n \u212b": "fin \u00e5", None: None, "": ""}
