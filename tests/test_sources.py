import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.gates import Refused, violations
from tallyspark.sources import pinned, sinks, strict_csv

SHARD = "id string, n int"


def put(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    data = content if isinstance(content, bytes) else content.encode()
    (folder / name).write_bytes(data)
    return hashlib.sha256(data).hexdigest(), len(data)


def shards(spark, folder, bodies, **change):
    rows = []
    for i, body in enumerate(bodies):
        sha, n = put(folder, f"rows-{i:03d}.json", body)
        records = len(json.loads(body)["records"]) if body.startswith("{") else 1
        rows.append({"path": f"rows-{i:03d}.json", "sha": sha, "bytes": n, "records": records})
    total = sum(r["records"] for r in rows)
    rows[0] |= change
    return spark.createDataFrame([(r["path"], r["sha"], r["bytes"], r["records"], total) for r in rows], "path string, sha string, bytes long, records int, record_count int")


def body(*records, **more):
    return json.dumps({"schemaVersion": "v1", "records": list(records)} | more)


GOOD = [body({"id": "a", "n": 1}, {"id": "b", "n": None}), body({"id": "c", "n": 3})]


def test_all_shards_are_read(spark, tmp_path):
    df = pinned.load_shards(spark, str(tmp_path / "s"), shards(spark, tmp_path / "s", GOOD), SHARD)
    assert sorted(map(tuple, df.collect())) == [("a", 1), ("b", None), ("c", 3)]


@pytest.mark.parametrize(
    ("bodies", "change"),
    [
        (GOOD, {"sha": "0" * 64}), (GOOD, {"bytes": 3}), (GOOD, {"records": 1}), (GOOD, {"path": "../x.json"}), (GOOD, {"sha": "xyz"}), (GOOD, {"bytes": 600_000}),
        ([GOOD[0], body({"id": "a", "n": 3})], {}), ([GOOD[0], body({"id": "", "n": 3})], {}), ([GOOD[0], body({"id": "c", "n": 3, "extra": 1})], {}), ([GOOD[0], body({"id": "c"})], {}), ([GOOD[0], body({"id": "c", "n": 3}, other=1)], {}),
        ([GOOD[0], '{"schemaVersion":"v1","records":[{"id":"c","n":1,"n":2}]}'], {}),
    ],
)
def test_any_fault_refuses_the_whole_collection(spark, tmp_path, bodies, change):
    with pytest.raises(Refused):
        pinned.load_shards(spark, str(tmp_path / "s"), shards(spark, tmp_path / "s", bodies, **change), SHARD)


def test_missing_and_invalid_bytes_are_refused(spark, tmp_path):
    sha, n = put(tmp_path / "d", "a.json", b'{"x":"\xff"}')
    pins = lambda *r: spark.createDataFrame(list(r), "name string, sha string, bytes long")
    found = pinned.files(spark, str(tmp_path / "d"))
    for p in (pins(("a.json", sha, n)), pins(("b.json", sha, n)), pins(("a.json", None, None))):
        with pytest.raises(Refused):
            pinned.verified(found, p)
    sha, n = put(tmp_path / "e", "a.json", '{"x":1}')
    assert pinned.verified(pinned.files(spark, str(tmp_path / "e")), pins(("a.json", sha, None))).first().text == '{"x":1}'
    for bound in (0, 3_000_000):
        with pytest.raises(ValueError):
            pinned.verified(found, pins(), bound)


@pytest.mark.parametrize("path", ["", "/a", "../a", "a/../../b", "a\\b"])
def test_paths(path):
    with pytest.raises(ValueError):
        pinned.check_path(path)


RECEIPT = {"status": "accepted", "reviewer": "r", "reviewedOn": "2026-01-02", "evidenceId": "e", "scope": "s", "limitations": [], "bundleSha256": "a" * 64, "checks": ["c"]}


@pytest.mark.parametrize(
    ("change", "fine"),
    [({}, True), ({"supersedesBundleSha256": "b" * 64}, True), ({"status": "draft"}, False), ({"note": "x"}, False), ({"bundleSha256": "A" * 64}, False), ({"reviewedOn": "2026-02-30"}, False), ({"checks": "c"}, False), ({"reviewer": ""}, False)],
)
def test_receipts(spark, change, fine):
    df = spark.createDataFrame([("i", json.dumps(RECEIPT | change))], "id string, receipt string")
    assert violations(df, pinned.receipt_rules("foundation")).isEmpty() is fine


def test_reviews_are_of_these_bytes(spark):
    good = json.dumps({"publication": {"allowed": True, "consequentialAllegation": False, "reviewId": "e", "reviewedOn": "2026-01-02"}})
    receipt = json.dumps(RECEIPT | {"bundleSha256": hashlib.sha256(good.encode()).hexdigest()})
    df = spark.createDataFrame([("a", good, receipt), ("b", good + " ", receipt), ("c", good.replace("true", "false"), receipt)], "id string, body string, receipt string")
    assert {r.key for r in violations(df, pinned.reviewed(df)).collect()} == {"b", "c"}


def test_inventory_and_release(spark, tmp_path):
    put(tmp_path / "snap", "hold.json", "{}")
    put(tmp_path / "snap/attempts/1", "outcome.json", "{}")
    rows = {(r.path, r.kind) for r in pinned.inventory(spark, str(tmp_path / "snap"), "s").collect()}
    assert rows == {("hold.json", "file"), ("attempts/1/outcome.json", "file"), ("attempts", "directory"), ("attempts/1", "directory")}
    put(tmp_path / "snap/a/b/c/d", "deep.json", "{}")
    assert pinned.inventory(spark, str(tmp_path / "snap"), "s").where("kind = 'directory'").count() == 6
    put(tmp_path / "snap/a/b/c/d/e", "deeper.json", "{}")
    with pytest.raises(Refused):
        pinned.inventory(spark, str(tmp_path / "snap"), "s")
    put(tmp_path / "out", "a.json", "{}")
    allowed = spark.createDataFrame([("a.json",)], "path string")
    manifest = sinks.release(spark, str(tmp_path / "out"), allowed)
    assert manifest.count() == 1 and sinks.identity(manifest).first().sha == sinks.identity(manifest).first().sha
    for names in ([("a.json",), ("b.json",)], [("b.json",)]):
        with pytest.raises(ValueError):
            sinks.release(spark, str(tmp_path / "out"), spark.createDataFrame(names, "path string"))


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "id string")
    sinks.write_new(df, str(tmp_path / "new"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_new(df, str(tmp_path / "new"))
    for bad in ("/x/public/y", "/x/Data/y", "/x/../y"):
        with pytest.raises(ValueError):
            sinks.check_target(bad)
    with pytest.raises(ValueError):
        sinks.check_target("/in/put/x", ["/in/put"])


def csv(spark, tmp_path, content, **options):
    put(tmp_path / "csv", "rows.csv", content)
    strict_csv.register(spark)
    return spark.read.format("strict_csv").options(path=str(tmp_path / "csv"), columns="Year,Payment Type", **options).load()


def test_strict_csv_reads(spark, tmp_path):
    got = csv(spark, tmp_path, 'Year,Payment Type\r\n2024,"a, ""b"""\r\n2025,\r\n').collect()
    assert sorted(map(tuple, got)) == [("2024", 'a, "b"'), ("2025", "")]


@pytest.mark.parametrize("content", ['Year,Payment Type\n2024,"a"x\n', 'Year,Payment Type\n2024,"a\n', "Payment Type,Year\n1,2\n", "Year,Payment Type\n1\n", "Year,Payment Type\n1,2,3\n", b"Year,Payment Type\n1,\xff\n", "", "Year,Payment Type\n" + "1,2\n" * 3])
def test_strict_csv_refuses(spark, tmp_path, content):
    with pytest.raises(Exception):  # noqa: B017
        csv(spark, tmp_path, content, max_rows="2").collect()


def test_json_objects(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ("[1]",), ('{"a":NaN}',), (None,)], "body string")
    assert [r.valid for r in pinned.strict_objects(df).select(F.coalesce("valid", F.lit(False)).alias("valid")).collect()] == [True, False, False, False, False]
