import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import journal, robots
from tallyspark.streaming import captures


def decide(spark, policy, url, token="audit"):
    p = spark.createDataFrame([("p", bytearray(policy if isinstance(policy, bytes) else policy.encode()))], "policy_id string, body binary")
    r = spark.createDataFrame([("r", "p", url, token)], "request_id string, policy_id string, url string, token string")
    return robots.decide(p, r).first()


SITE = "https://a.b"


@pytest.mark.parametrize(
    ("policy", "path", "status"),
    [
        ("User-agent: *\nDisallow: /a\nAllow: /a/b\n", "/a/b/c", "allow"),
        ("User-agent: *\nDisallow: /a\nAllow: /a/b\n", "/a/c", "disallow"),
        ("User-agent: *\nDisallow: /a\nAllow: /a\n", "/a", "allow"),
        ("User-agent: *\nDisallow: /*.gif$\n", "/x/y.gif", "disallow"),
        ("User-agent: *\nDisallow: /*.gif$\n", "/x/y.gif?z", "allow"),
        ("User-agent: *\nDisallow: *.gif$\n", "/y.gif", "disallow"),
        ("User-agent: *\nDisallow: /a**b*$\n", "/axxb/more", "disallow"),
        ("User-agent: *\nDisallow: /%61bc\n", "/abc", "disallow"),
        ("User-agent: *\nDisallow: /a%2fb\n", "/a%2Fb", "disallow"),
        ("User-agent: *\nDisallow: /a%2Fb\n", "/a/b", "allow"),
        ("User-agent: *\nDisallow: /é\n", "/%C3%A9", "disallow"),
        ("User-agent: *\nDisallow:\n", "/a", "allow"),
        ("User-agent: *\nDisallow: /\n", "/robots.txt", "allow"),
        ("User-agent: other\nDisallow: /\n", "/a", "allow"),
        ("User-agent: *\nDisallow: /\n\nUser-agent: AUDIT\nAllow: /\n", "/a", "allow"),
        ("User-agent: audit\nDisallow: /x\nUser-agent: audit\nDisallow: /y\n", "/y", "disallow"),
        ("User-agent: one\nUser-agent: audit # me\nDisallow: /x\n", "/x", "disallow"),
        ("Sitemap: https://a.b/s.xml\nUser-agent: *\nSitemap: https://a.b/t.xml\nUser-agent: audit\nDisallow: /x\n", "/x", "disallow"),
        ("", "/a", "allow"),
    ],
)
def test_matching(spark, policy, path, status):
    assert decide(spark, policy, SITE + path).status == status


@pytest.mark.parametrize(
    ("policy", "url", "token"),
    [
        ("Disallow: /a\n", SITE + "/a", "audit"), ("User-agent: *\nNoindex: /a\n", SITE + "/a", "audit"), ("User-agent: *\nDisallow: a\n", SITE + "/a", "audit"), ("User-agent: *\nDisallow: /a$b\n", SITE + "/a", "audit"),
        ("User-agent: *\nDisallow: /%zz\n", SITE + "/a", "audit"), ("User-agent: *\nCrawl-delay: 4000\n", SITE + "/a", "audit"), ("<html></html>", SITE + "/a", "audit"), (b"\xff\xfe", SITE + "/a", "audit"), ("User-agent: a b\n", SITE + "/a", "audit"),
        ("User-agent: *\nnonsense\n", SITE + "/a", "audit"), ("User-agent: *\nDisallow: /a\n", "ftp://a.b/a", "audit"), ("User-agent: *\nDisallow: /a\n", SITE + "/a#x", "audit"), ("User-agent: *\nDisallow: /a\n", SITE + "/%z", "audit"),
        ("User-agent: *\nDisallow: /a\n", SITE + "/a", "Audit/1.0"), ("User-agent: *\nDisallow: /a\n", None, "audit"), ("User-agent: *\n" + "".join(f"Disallow: /{'*a' * 300}{i}\n" for i in range(5)), SITE + "/" + "a" * 4000, "audit"),
    ],
)
def test_anything_odd_needs_review(spark, policy, url, token):
    got = decide(spark, policy, url, token)
    assert got.status == "review_required" and got.reason


def test_delay(spark):
    got = decide(spark, "User-agent: *\nCrawl-delay: 2.5\nDisallow: /x\n", SITE + "/a")
    assert (got.delay, got.selection) == (2.5, "wildcard_fallback")
    d = spark.createDataFrame([("allow", 2.5), ("allow", 0.0)], "status string, delay double")
    assert tuple(robots.waiting(d).first()) == (2.5, False)
    assert robots.waiting(d.union(spark.createDataFrame([("disallow", 0.0)], d.schema))).first().hold
    assert robots.waiting(d.withColumn("delay", F.lit(11.0))).first().hold


EVENT = "dataset string, attempt string, seq long, kind string, status string, at string"


def may(spark, *rows, now="2024-02-01 00:00:00"):
    events = spark.createDataFrame([("d", *r) for r in rows], EVENT).withColumn("at", F.to_timestamp("at"))
    return journal.admission(events, F.to_timestamp(F.lit(now))).first().reason


def test_admission(spark):
    base = ("b", 0, "baseline", "accepted", "2024-01-01 00:00:00")
    done = ("a", 2, "outcome", "candidate_prepared", "2024-01-20 00:00:00")
    assert may(spark, base, done) is None
    assert may(spark, base, done, now="2024-01-26 23:59:59") == "cadence"
    assert may(spark, done) == "no baseline"
    assert may(spark, base, ("a", 1, "attempt", "started", "2024-01-02 00:00:00")) == "unresolved attempt"
    assert may(spark, base, ("a", 2, "outcome", "held_no_retry", "2024-01-02 00:00:00")) == "failed attempt"
    assert may(spark, base, done, ("h", 1, "hold", "x", None)) == "hold"
    assert may(spark, base, done, ("l", 1, "lock", "x", None)) == "lock"


ROWS = [("2023-2024", "t", "s", "1.00"), ("2024-2025", "t", "s", "-2.50")]
KIND = "year string, type string, subcategory string, amount string"


def test_refresh(spark):
    base = spark.createDataFrame(ROWS, KIND)
    changed, _ = journal.candidate(base, base)
    assert changed.where("change <> 'same'").count() == 0
    changed, cover = journal.candidate(spark.createDataFrame([*ROWS[:1], ("2024-2025", "t", "s", "3.00"), ("2025-2026", "t", "s", "0.00")], KIND), base)
    assert {r.change for r in changed.collect()} == {"same", "changed", "added"}
    assert {(r.year, r.n_old, r.n_new) for r in cover.collect()} == {("2023-2024", 1, 1), ("2024-2025", 1, 1), ("2025-2026", 0, 1)}


@pytest.mark.parametrize(
    "extra", [[("2023-2024", "t", "new", "1.00")], ROWS[:1], [("2023-2025", "t", "s", "1.00")], [("2026-2027", "t", "s", "1")], [("2026-2027", "t", "s", "01.00")], [("2026-2027", "t", "s", "10000000000.01")], [("2026-2027", "t", "s", None)]]
)
def test_refresh_holds(spark, extra):
    base = spark.createDataFrame(ROWS, KIND)
    with pytest.raises(journal.Hold):
        journal.candidate(spark.createDataFrame([*ROWS, *extra], KIND), base)


def test_empty_refresh_is_not_a_deletion(spark):
    with pytest.raises(journal.Hold):
        journal.candidate(spark.createDataFrame([], KIND), spark.createDataFrame(ROWS, KIND))


def test_captures(spark):
    import hashlib

    body = b"Year,Amount\n1,2\n"
    good = {
        "url": "https://a.b/c", "status": 200, "complete": True, "bodyBytes": len(body), "bodySha256": hashlib.sha256(body).hexdigest(), "headers": {"content-type": "text/csv; charset=utf-8", "content-length": " 00" + str(len(body))},
        "attemptedAt": "2024-01-01T00:00:00Z", "headersReceivedAt": "2024-01-01T00:00:01Z", "completedAt": "2024-01-01T00:00:02Z", "transportError": None, "disposition": "received_for_semantic_review",
    }
    changes = [{}, {"status": 404}, {"bodyBytes": 1}, {"completedAt": "2024-01-01T00:01:02Z"}, {"completedAt": "2024-01-01T00:00:02"}, {"headers": {"content-type": "text/html"}}, {"transportError": "x"}, {"headers": good["headers"] | {"content-length": "x"}}]
    changes += [{"responseURL": "https://z.b/c"}, {"responseURL": None}, {"headersComplete": False}, {"disposition": "held"}, {"disposition": None}, {"status": "200"}, {"complete": "true"}, {"bodyBytes": str(len(body))}]
    fine = [{"responseURL": good["url"]}, {"headersComplete": True}]
    df = spark.createDataFrame([(str(i), bytearray(body), "https://a.b/c", "text/csv", json.dumps(good | c)) for i, c in enumerate(changes + fine)], "name string, body binary, wanted_url string, wanted_type string, receipt string")
    got = {r.name: r.problems for r in journal.capture_problems(df).collect()}
    assert got["0"] == [] and all(got[str(i)] for i in range(1, len(changes))) and [got[str(len(changes) + i)] for i in range(2)] == [[], []]
    big = df.limit(1).withColumn("body", F.encode(F.repeat(F.lit("x"), (1 << 20) + 1), "UTF-8"))
    assert "oversized body" in journal.capture_problems(big).first().problems
    challenge = df.limit(1).withColumn("body", F.lit(b"please solve the CAPTCHA"))
    assert "access challenge" in journal.capture_problems(challenge).first().problems


def test_findings(spark):
    sha = "c" * 64
    files = [
        ("baseline-retrieval.json", 5, "x", "{}"), ("hold.json", 5, "x", '{"completedAtEpoch": 5}'), ("odd.txt", 1, "x", None), ("attempts/1/admission.json", 2, "x", '{"a":1,"a":2}'), ("attempts/1/robots-decisions.json", 2, "x", "{}"),
        ("attempts/1/outcome.json", 2, "x", json.dumps({"status": "candidate_prepared", "completedAtEpoch": 7.5, "candidateSha256": sha})), ("attempts/1/candidate.private.json", 2, "d" * 64, "{}"),
    ]
    df = spark.createDataFrame([("s", p, "file", b, h, t) for p, b, h, t in files], "snapshot string, path string, kind string, bytes long, sha string, body string")
    got = {(r.code, r.path) for r in journal.findings(df).collect()}
    assert {
        ("persistent_hold_preserved", "hold.json"), ("unrecognized_artifact_preserved", "odd.txt"), ("malformed_journal_record", "attempts/1/admission.json"), ("candidate_outcome_binding_unverified", "attempts/1/outcome.json"),
        ("missing_journal_record", "attempts/1/robots.attempt.json"), ("missing_journal_record", "attempts/1/payments.receipt.json"),
    } <= got
    assert ("missing_journal_record", "baseline-retrieval.json") not in got
    assert journal.clocks(df).count() == 2


def test_readiness(spark):
    pins = spark.createDataFrame([("a", "a" * 64), ("b", "b" * 64), ("c", "c" * 64)], "path string, sha string")
    files = spark.createDataFrame([("a", "a" * 64), ("b", "f" * 64)], "path string, sha string")
    held, flags = spark.createDataFrame([("h",)], "path string"), spark.createDataFrame([("on", True), ("off", False), ("unknown", None)], "name string, enabled boolean")
    assert {tuple(r) for r in journal.ready(pins, files, held, flags).collect()} == {("pin", "b"), ("pin", "c"), ("hold", "h"), ("flag", "on"), ("flag", "unknown")}


def test_stream_folds_like_the_batch(spark, tmp_path):
    rows = [("d", "a", 1, "attempt", "started", "2024-01-01T00:00:00Z"), ("d", "a", 2, "outcome", "candidate_prepared", "2024-01-01T00:01:00Z"), ("d", "a", 2, "outcome", "candidate_prepared", "2024-01-01T00:01:00Z"), ("e", "b", 1, "outcome", "held_no_retry", "2024-01-02T00:00:00Z")]
    (tmp_path / "in").mkdir()
    names = [c.split()[0] for c in captures.EVENT.split(", ")]
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
    for name, shape in (("latest", captures.latest), ("daily", captures.daily)):
        stream = shape(captures.journal_stream(spark, str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete" if name == "daily" else "update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r.dataset, r.status) for r in spark.table("latest").collect()} == {("d", "candidate_prepared"), ("e", "held_no_retry")}
    assert {(r.dataset, r.n_failed) for r in spark.table("daily").collect()} == {("d", 0), ("e", 1)}


def test_receipts_of_retained_snapshots_have_typed_values(spark):
    good = {"attemptedAt": "2024-01-01T00:00:00Z", "completedAt": "2024-01-01T00:00:01Z", "status": 200, "complete": True, "headersComplete": True, "workerTermination": "confirmed"}
    cases = [{}, {"status": "200"}, {"complete": "true"}, {"headersComplete": "true"}, {"attemptedAt": None}]
    rows = [(f"s{i}", "attempts/1/robots.receipt.json", "file", 1, "x", json.dumps(good | change)) for i, change in enumerate(cases)]
    found = journal.findings(spark.createDataFrame(rows, "snapshot string, path string, kind string, bytes long, sha string, body string")).collect()
    of = lambda code: sorted(r.snapshot for r in found if r.code == code)
    assert of("failed_or_uncertain_response_preserved") == ["s1", "s2", "s3"]
    assert of("unknown_request_time") == ["s4"]


def test_findings_of_repeated_files_are_those_of_every_pair(spark):
    """Bindings and missing files against brute force, with files and claims that repeat and snapshots that are unknown; nothing is joined."""
    pick = random.Random(5).choice
    names = ["outcome.json", "candidate.private.json", "robots.receipt.json", "robots.body", "x/y.receipt.json", "x/y.body", "admission.json"]
    rows = []
    for _ in range(600):
        path = pick(["baseline-retrieval.json", *[f"attempts/{pick('12')}/{pick(names)}" for _ in range(6)]])
        body = {"status": "candidate_prepared", "publicationAllowed": pick([False, False, True]), "candidateSha256": pick("ab"), "bodySha256": pick("ab"), "bodyBytes": pick([1, 1, "z"])}
        rows.append((pick([None, *map(str, range(60))]), path, pick(["file", "file", "link"]), pick([1, 1, None]), pick(["a", "b", None]), pick([json.dumps(body)] * 3 + ["{"]) if path.endswith(".json") else None))
    wanted = set()
    for snapshot, path, _, _, _, body in rows:
        mine = [r for r in rows if r[0] == snapshot and snapshot is not None]
        there, run = {r[1] for r in mine}, path.split("/")[1] if "/" in path else None
        files = ["baseline-retrieval.json"]
        if run:
            files += [f"attempts/{run}/{f}" for f in ("outcome.json", "admission.json", "robots-decisions.json", *[f"{k}{s}" for k in journal.KINDS for s in (".attempt.json", ".receipt.json")])]
        wanted |= {(snapshot, "missing_journal_record", f) for f in files if f not in there}
        receipt = path.endswith(".receipt.json")
        if body in (None, "{") or not (receipt or path.endswith("/outcome.json")):
            continue
        said = json.loads(body)
        bound = path.replace(".receipt.json", ".body").replace("outcome.json", "candidate.private.json")
        says = said["bodySha256"] if receipt else None if said["publicationAllowed"] else said["candidateSha256"]
        found = [r for r in mine if r[1] == bound and r[2] == "file"]
        if not found or any(says is None or r[4] != says or (receipt and r[3] != said["bodyBytes"]) for r in found):
            wanted.add((snapshot, "response_body_binding_unverified" if receipt else "candidate_outcome_binding_unverified", path))
    made = journal.findings(spark.createDataFrame(rows, "snapshot string, path string, kind string, bytes long, sha string, body string"), parts=7)
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(set(got))
    assert {r for r in got if "binding" in r[1] or "missing" in r[1]} == wanted
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and set(re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", text)) == {"7"}
