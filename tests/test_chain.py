"""Chains of digests and still folders: a change at any level, or between two looks, is refused."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.gates import Refused
from tallyspark.sources import pinned


def put(folder, name, value):
    body = value if isinstance(value, str) else json.dumps(value)
    (folder / name).write_text(body)
    return {"path": name, "sha256": hashlib.sha256(body.encode()).hexdigest(), "bytes": len(body.encode())}


@pytest.fixture
def collection(tmp_path):
    def build(shards=((1, 2), (3,)), **receipt):
        links = [[put(tmp_path, f"rows-{m}{i}.json", {"schemaVersion": "v1", "records": [{"id": str(x)} for x in part]}) | {"records": len(part)} for i, part in enumerate(shards)] for m in range(2)]
        for i, x in enumerate(links[1]):  # identities of the second manifest are others
            links[1][i] = put(tmp_path, x["path"], {"schemaVersion": "v1", "records": [{"id": f"b{n}"} for n in shards[i]]}) | {"records": len(shards[i])}
        manifests = [put(tmp_path, f"manifest-{m}.json", {"shards": links[m], "recordCount": sum(map(len, shards))}) for m in range(2)]
        index = put(tmp_path, "index.json", {"manifests": manifests})
        put(tmp_path, "receipt.json", {"status": "accepted", "reviewer": "r", "evidenceId": "e", "indexSha256": index["sha256"]} | receipt)
        return tmp_path

    return build


def load(spark, folder):
    return sorted(r.id for r in pinned.load_collection(spark, str(folder), "receipt.json", "id string").collect())


def test_a_chain_of_four_levels(spark, collection):
    folder = collection()
    rows = pinned.load_collection(spark, str(folder), "receipt.json", "id string")
    put(folder, "rows-00.json", "{}")
    put(folder, "manifest-0.json", "{}")
    assert sorted(r.id for r in rows.collect()) == ["1", "2", "3", "b1", "b2", "b3"]


@pytest.mark.parametrize("name", ["index.json", "manifest-1.json", "rows-10.json"])
def test_a_change_at_any_level_is_refused(spark, collection, name):
    folder = collection()
    text = (folder / name).read_text()
    (folder / name).write_text(text + " ")
    with pytest.raises(Refused):
        load(spark, folder)
    (folder / name).write_text(text)
    assert len(load(spark, folder)) == 6
    (folder / name).unlink()
    with pytest.raises(Refused):
        load(spark, folder)


def test_receipts_and_manifests_are_judged(spark, collection):
    for wrong in ({"status": "draft"}, {"reviewer": ""}, {"evidenceId": None}, {"indexSha256": "0" * 64}):
        with pytest.raises(Refused):
            load(spark, collection(**wrong))
    folder = collection()
    manifest = json.loads((folder / "manifest-0.json").read_text())
    for wrong in ({"recordCount": 4}, {"shards": manifest["shards"][:1]}, {"shards": [manifest["shards"][0] | {"records": 1}, manifest["shards"][1] | {"records": 2}]}, {"shards": [manifest["shards"][0] | {"path": "../rows-00.json"}, manifest["shards"][1]]}):
        link = put(folder, "manifest-0.json", manifest | wrong)
        index = put(folder, "index.json", {"manifests": [link]})
        put(folder, "receipt.json", {"status": "accepted", "reviewer": "r", "evidenceId": "e", "indexSha256": index["sha256"]})
        with pytest.raises(Refused):
            load(spark, folder)


def test_rings_long_chains_and_two_pins(spark, tmp_path):
    first = lambda *names: spark.createDataFrame([(n, None, None) for n in names], "name string, sha string, bytes long")
    links = F.transform(F.coalesce(F.from_json(F.get_json_object("text", "$.next"), "array<struct<path:string,sha256:string,bytes:bigint>>"), F.array()), lambda x: F.struct(x["path"].alias("name"), x["sha256"].alias("sha"), x["bytes"].alias("bytes"), F.lit(0).cast("long").alias("records")))
    at = put(tmp_path, "f9.json", {"next": []})
    for i in range(8, -1, -1):
        at = put(tmp_path, f"f{i}.json", {"next": [at]})
    got = pinned.chain(spark, str(tmp_path), first("f0.json"), links)
    assert [(r.level, r.name) for r in got.orderBy("level").collect()] == [(i, f"f{i}.json") for i in range(10)]
    with pytest.raises(Refused, match="more than 4 levels"):
        pinned.chain(spark, str(tmp_path), first("f0.json"), links, most_levels=4)
    other = put(tmp_path, "g.json", {"next": [at | {"sha256": "1" * 64}]})
    put(tmp_path, "top.json", {"next": [other, at]})
    with pytest.raises(Refused, match="same_digest|one_pin|digest"):
        pinned.chain(spark, str(tmp_path), first("top.json"), links)
    put(tmp_path, "top.json", {"next": [at, at]})
    assert pinned.chain(spark, str(tmp_path), first("top.json"), links).count() == 11


def test_paths_have_one_form():
    for path in ("", "/a", "a//b", "./a", "a/./b", "a/", "../a", "a/..", "a\\b", "a\0"):
        with pytest.raises(ValueError):
            pinned.check_path(path)
    assert pinned.check_path("a/b.json") == "a/b.json" and pinned.check_path("..a") == "..a"


def names(df):
    return {(r.path, r.kind, r.body) for r in df.collect()}


def test_an_inventory_is_of_a_still_folder(spark, tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    put(tmp_path / "a", "x.json", "one")
    put(tmp_path, "y.json", "two")
    want = {("a/x.json", "file", "one"), ("y.json", "file", "two"), ("a", "directory", None)}
    got = pinned.inventory(spark, str(tmp_path), "s")
    put(tmp_path, "y.json", "changed")
    put(tmp_path, "z.json", "new")
    assert names(got) == want
    (tmp_path / "z.json").unlink()
    freeze = pinned.freeze
    for step, act in ((1, lambda: put(tmp_path, "y.json", "longer than before")), (2, lambda: put(tmp_path, "new.json", "new")), (1, lambda: (tmp_path / "new.json").unlink())):
        looks = []

        def between(df, step=step, act=act, looks=looks):
            out = freeze(df)
            looks.append(1)
            if len(looks) == step:
                act()
            return out

        monkeypatch.setattr(pinned, "freeze", between)
        with pytest.raises(Exception, match="not still|FILE_NOT_EXIST|does not exist"):
            pinned.inventory(spark, str(tmp_path), "s").collect()
        monkeypatch.setattr(pinned, "freeze", freeze)


def test_entries_are_bounded_with_folders(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"d{i}").mkdir()
        put(tmp_path / f"d{i}", "x.json", "{}")
    monkeypatch.setattr(pinned, "MOST_ENTRIES", 6)
    assert pinned.inventory(spark, str(tmp_path), "s").count() == 6
    monkeypatch.setattr(pinned, "MOST_ENTRIES", 5)
    with pytest.raises(Refused, match="entries"):
        pinned.inventory(spark, str(tmp_path), "s")
