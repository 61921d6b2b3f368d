"""The steps of matching a policy: counted state by state, on random rules and on policies of many."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import robots

SITE = "https://h.example"


def slow_steps(pattern, target):
    """States by a table: row i has the numbers of atoms that i octets may have matched."""
    end, atoms = pattern.endswith("$"), []
    for c in pattern.rstrip("$"):
        if c != "*" or atoms[-1:] != ["*"]:
            atoms.append(c)
    if atoms and atoms[-1] == "*":
        atoms.pop()
        end = False
    wild = lambda p: p < len(atoms) and atoms[p] == "*"
    row = {0} | ({1} if wild(0) else set())
    cost = len(row)
    for c in target:
        if not row or (not end and len(atoms) in row):
            break
        cost += len(row)
        hit = {p + 1 for p in row if p < len(atoms) and atoms[p] == c} | {p for p in row if wild(p)}
        row = hit | {p + 1 for p in hit if wild(p)}
        cost += len(row)
    return cost


def counted(spark, patterns, target, most=10**9):
    body = "User-agent: *\n" + "".join(f"Disallow: {p}\n" for p in patterns)
    policies = spark.createDataFrame([("p", bytearray(body.encode()), target)], "policy_id string, body binary, target string")
    met = robots.profiles(policies.select("policy_id", "body")).join(policies, "policy_id").withColumn("target", F.split("target", ""))
    met = met.withColumn("text", F.array_join(F.transform("target", lambda o: F.concat(F.lit(robots.MARK), o)), ""))
    each = F.transform("rules", lambda r: F.struct(r["line"].alias("line"), robots.steps(F.col("target"), F.col("text"), r, F.lit(0).cast("long"), most).alias("n"), robots.most_steps(F.size("target").cast("long"), r).alias("most")))
    return {r.line - 2: (r.n, r.most) for r in met.select(F.explode(each).alias("e")).select("e.*").collect()}


def test_steps_of_random_rules(spark):
    rng = random.Random(4)
    patterns = ["/" + "".join(rng.choice("aab/***") for _ in range(rng.randrange(9))) + rng.choice(["", "", "$"]) for _ in range(150)] + ["*", "*a", "/*$", "/", "/$"]
    for n in (0, 3, 12, 40):
        target = "/" + "".join(rng.choice("aab/") for _ in range(n))
        got = counted(spark, patterns, target)
        assert {i: g[0] for i, g in got.items()} == {i: slow_steps(p, target) for i, p in enumerate(patterns)}
        assert all(n <= most for n, most in got.values())


def decide(spark, body, path):
    p = spark.createDataFrame([("p", bytearray(body.encode()))], "policy_id string, body binary")
    return robots.decide(p, spark.createDataFrame([("r", "p", SITE + path, "audit")], "request_id string, policy_id string, url string, token string")).first()


@pytest.mark.parametrize("n", [1, 2000, 5000])
def test_many_short_rules_are_decided(spark, n):
    body = "User-agent: *\nDisallow: /\n" + "".join(f"Allow: /{'x' * (i % 40)}{i}\n" for i in range(n))
    path = f"/{'x' * ((n - 1) % 40)}{n - 1}"
    assert decide(spark, body, path + "/" + "y" * 70).status == "allow" and decide(spark, body, "/z" * 40).status == "disallow"


def test_work_beyond_the_limit_needs_review(spark, monkeypatch):
    bomb = ["/" + "*a" * 300 + str(i) for i in range(5)]
    target = "/" + "a" * 4000
    assert sum(slow_steps(p, target) for p in bomb) > robots.MOST_STEPS
    got = decide(spark, "User-agent: *\n" + "".join(f"Disallow: {p}\n" for p in bomb), target)
    assert (got.status, got.reason) == ("review_required", "too much work")
    long = "User-agent: *\n" + "".join(f"Disallow: /{'a' * 500}{i}\n" for i in range(100))
    assert decide(spark, long, target).status == "allow"  # sizes multiply to more than the limit, steps do not


def test_the_limit_is_exact(spark, monkeypatch):
    patterns, target = ["/*a*b", "/a*$", "/aab*b*a", "/zz"], "/aababbaabab"
    total = sum(slow_steps(p, target) for p in patterns)
    body = "User-agent: *\n" + "".join(f"Disallow: {p}\n" for p in patterns)
    monkeypatch.setattr(robots, "MOST_STEPS", total)
    assert decide(spark, body, target).status == "disallow"
    monkeypatch.setattr(robots, "MOST_STEPS", total - 1)
    assert decide(spark, body, target).status == "review_required"


def test_policies_without_bounds_are_looked_up(spark):
    """A policy beyond the fixed bounds, of plain rules by the ten thousand: held, and decided where the bounds are lifted."""
    rules = [f"{'Disallow' if i % 2 else 'Allow'}: /page/{i}{'$' if i % 3 == 0 else ''}" for i in range(30_000)] + ["Disallow: /", "Allow: /page/7*/x", "Disallow: /page/12", "Allow: /page/12"]
    policies = spark.createDataFrame([("p", bytearray(("User-agent: *\n" + "\n".join(rules)).encode()))], "policy_id string, body binary")
    asked = [("a", "/page/29999"), ("b", "/page/29998"), ("c", "/page/29997"), ("d", "/page/12"), ("e", "/none"), ("f", "/page/71/x"), ("g", "/page/3000x")]
    requests = spark.createDataFrame([(i, "p", f"https://h.example{path}", "t") for i, path in asked], "request_id string, policy_id string, url string, token string")
    assert {r.reason for r in robots.decide(policies, requests).collect()} == {"oversized"}
    got = {r.request_id: (r.status, r.winners) for r in robots.decide(policies, requests, bounded=False).collect()}
    # lines count from one, after the line of the agent
    assert got == {"a": ("disallow", [30001]), "b": ("allow", [30000]), "c": ("disallow", [29999]), "d": ("allow", [14]), "e": ("disallow", [30002]), "f": ("allow", [30003]), "g": ("disallow", [30002])}
