import pytest
from pyspark.sql import functions as F

from tallyspark.operators import gates

ROWS = "id string, a int, b int, parent string"
GOOD = [("x", 1, 2, "p"), ("y", 2, 2, "q")]


def rules(spark):
    parents = spark.createDataFrame([("p",), ("q",)], "parent string")
    return [*gates.named(), gates.row("ordered", F.col("a") <= F.col("b")), gates.key("pair", "a", "b"), gates.agg("sum", F.sum("a") == 3), gates.group("few", F.count("*") < 2, "parent"), gates.fk("parent", ["parent"], parents)]


def broken(spark, data):
    return {(r.rule_id, r.key) for r in gates.violations(spark.createDataFrame(data, ROWS), rules(spark)).collect()}


def test_good_rows_are_admitted(spark):
    df = spark.createDataFrame(GOOD, ROWS)
    assert gates.admit(df, rules(spark)).count() == 2


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        (lambda g: g[:1], {("sum", "*")}),
        (lambda g: [*g, g[1]], {("id_unique", "y"), ("pair", "2|2"), ("sum", "*"), ("few", "q")}),
        (lambda g: [g[0], ("y", None, 2, "q")], {("ordered", "y"), ("sum", "*")}),
        (lambda g: [g[0], ("y", 3, 2, "q")], {("ordered", "y"), ("sum", "*")}),
        (lambda g: [g[0], ("", 2, 2, "q")], {("id_present", "")}),
        (lambda g: [g[0], (None, 2, 2, "q")], {("id_present", "null")}),
        (lambda g: [g[0], ("y", 2, 2, "r")], {("parent", "r")}),
        (lambda g: [g[0], ("y", 2, 2, None)], {("parent", "null")}),
        (lambda g: [], {("sum", "*")}),
    ],
)
def test_every_mutation_is_refused(spark, change, expected):
    assert broken(spark, change(GOOD)) == expected
    with pytest.raises(gates.Refused):
        gates.admit(spark.createDataFrame(change(GOOD), ROWS), rules(spark))


def test_optional_parts_are_left_out_and_required_ones_raise(spark):
    good, bad = spark.createDataFrame(GOOD, ROWS), spark.createDataFrame(GOOD[:1], ROWS)
    kept, lost = gates.admit_optional({"a": (good, rules(spark)), "b": (bad, rules(spark))}, required=["a"])
    assert (list(kept), lost) == (["a"], ["b"])
    with pytest.raises(gates.Refused):
        gates.admit_optional({"b": (bad, rules(spark))}, required=["b"])


def test_profile_counts_rows(spark):
    df = spark.createDataFrame([*GOOD, ("z", 5, 1, "p")], ROWS)
    assert {(r.rule_id, r.n_rows, r.n_broken) for r in gates.profile(df, rules(spark)).collect()} == {("id_present", 3, 0), ("ordered", 3, 1)}
