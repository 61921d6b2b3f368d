import re

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, exact, hashing, text, urls
from tallyspark.operators import catalog


def values(spark, ddl, data, *exprs):
    return [tuple(r) for r in spark.createDataFrame(data, ddl).select(*exprs).collect()]


def one(spark, data, expr, ddl="x string"):
    return [r[0] for r in values(spark, ddl, [(d,) for d in data], expr)]


def test_decimals_refuse_other_numbers(spark):
    raw = ["1", "-1.50", "1.", "+1", "1e3", "NaN", "", None, "1\n", "٣", "1,000"]
    assert one(spark, raw, exact.is_decimal(F.col("x"))) == [True, True] + [False] * 9


def test_tokens_keep_missing_apart_from_zero(spark):
    got = one(spark, ["(1,234)", "1,234.50", "0", "-", "", None, "n/a", "---"], exact.source_token(F.col("x")))
    assert [(r.presence, r.value) for r in got] == [
        ("present", "-1234"), ("present", "1234.50"), ("present", "0"), ("source_dash", None), ("blank", None), ("missing", None), ("malformed", None), ("malformed", None),
    ]


def test_scaling_is_exact(spark):
    data = [("9007199254740.991", 1000), ("9007199254740.992", 1000), ("0.0000000001", 1000), ("-1.5", 10), ("1.5", 1), ("x", 10), (None, 10), ("2", 0)]
    got = [r[0] for r in values(spark, "x string, m long", data, exact.scale_exact(F.col("x"), F.col("m")))]
    assert got == [9007199254740991, None, None, -15, None, None, None, None]


def test_scaling_of_long_text(spark):
    """As whole numbers of any length do it, with zeros in front and behind, and at the bounds."""
    import random
    from fractions import Fraction

    rng = random.Random(2)
    data = [("1." + "0" * 22, 3), ("0" * 100 + "7.50" + "0" * 20, 2), (str(5**52)[:-52] + "0." + str(5**52).rjust(52, "0"), 2**52), ("-0.00", 5), ("9007199254740991", 1), ("9007199254740992", 1), ("1" * 128, 1), ("0" * 127 + "1", 9007199254740991), ("0" * 128 + "1", 1), ("1", 9007199254740992), ("1", 0), ("1e3", 1), ("٣", 1), ("1.", 1)]
    for _ in range(300):
        whole, places = str(rng.randrange(10 ** rng.randrange(1, 17))), rng.randrange(12)
        text = rng.choice(["", "-"]) + "0" * rng.randrange(30) + whole + ("." + "".join(rng.choice("05") for _ in range(places)) + "0" * rng.randrange(40) if places else "")
        data.append((text, rng.choice([1, 1000, 10**6, 2**30, 10**12])))

    def slow(text, m):
        if not re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", text) or len(text) > 128 or not 1 <= m <= 2**53 - 1:
            return None
        value = Fraction(text) * m
        return int(value) if value.denominator == 1 and abs(value) <= 2**53 - 1 else None

    got = [r[0] for r in values(spark, "x string, m long", data, exact.scale_exact(F.col("x"), F.col("m")))]
    assert got == [slow(x, m) for x, m in data] and sum(g is not None for g in got) > 50


def test_scaling_multiplies_once(spark):
    """The product is one expression of the plan, however often it is looked at; short text is one decimal."""
    df = spark.createDataFrame([("1.5", 10)], "x string, m long").select(exact.scale_exact(F.col("x"), F.col("m")).alias("v"))
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1


def test_text_that_has_no_canonical_form(spark):
    raw = ['{"b":1,"a":"é"}', '{"a":"\\ud800"}', "[" * 100_000 + "]" * 100_000, '{"a":NaN}', '{"a":1,"a":2}', '{"a":1e999}', "x", None, '{"\\ud800":{"url":"https://a.b/\\udc00"}}']
    assert one(spark, raw, hashing.canonical()(F.col("x"))) == ['{"a":"é","b":1}', None, None, None, '{"a":2}', None, None, None, None]
    got = one(spark, raw, hashing.unapproved(F.col("x"), {"root": ["a", "b"]}))
    assert got[1] == [] and got[2] == ["root"] and got[8] == ["root.\\ud800"] and got[7] is None
    found = catalog.https_urls(spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "id int, body string")).orderBy("id").collect()
    assert found[8].urls == ["https://a.b/\\udc00"] and found[2].urls == []


def test_differences_are_not_binary(spark):
    got = values(spark, "a string, b string", [("0.3", "0.2")], (exact.to_decimal(F.col("a")) - exact.to_decimal(F.col("b"))).cast("string"))
    assert got == [("0.100000",)]


def test_display(spark):
    assert one(spark, ["1234567.80", "-12", "abc", None], exact.grouped(F.col("x"))) == ["1,234,567.80", "-12", "Not established", "Not established"]
    assert one(spark, [1234.5, -3.0, None, float("nan")], exact.display_money(F.col("x"), 0), "x double") == ["$1,234", "-$3", "Not established", "Not established"]


def test_millions_as_dollars(spark):
    assert one(spark, ["$12.3", "12.3", None], exact.hundred_thousands(F.col("x"))) == [12_300_000, None, None]


def test_rounded_percent(spark):
    data = [(67, 2, 3), (66, 2, 3), (50, 1, 2), (None, 1, 2)]
    assert [r[0] for r in values(spark, "p int, a int, b int", data, exact.rounded_percent_holds(F.col("p"), F.col("a"), F.col("b")))] == [True, False, True, False]


def test_strict_dates(spark):
    raw = ["2024-02-29", "2023-02-29", "2024-2-3", "2024-02-03\n", None, "2024-02-03T00:00:00"]
    assert one(spark, raw, dates.is_date(F.col("x"))) == [True] + [False] * 5


def test_instants_need_an_offset(spark):
    raw = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00", "x", None]
    got = one(spark, raw, dates.instant(F.col("x")).cast("string"))
    assert got == ["2024-01-01 00:00:00", "2023-12-31 22:00:00", None, None, None]


def test_fiscal_years(spark):
    assert one(spark, ["2024-03-31", "2024-04-01", "1999-12-01"], dates.fiscal_year(F.col("x").cast("date"))) == ["2023-24", "2024-25", "1999-00"]
    got = one(spark, ["2025-26", "2021-2022", "2024/25", "2024-26", "2024-2026", "24-25", None], dates.fiscal_bounds(F.col("x"))["start"].cast("string"))
    assert got == ["2025-04-01", "2021-04-01", "2024-04-01", None, None, None, None]


def test_periods(spark):
    data = [("flow", "2024-04-01", "2025-03-31", None), ("flow", "2024-04-01", "2025-03-31", "2025-03-31"), ("stock", "2024-04-01", "2025-03-31", "2025-03-31"), ("stock", "2024-04-01", "2025-03-31", None), ("flow", "2025-04-01", "2024-03-31", None)]
    got = values(spark, "m string, a string, b string, c string", data, dates.period_holds(*[F.col(x) for x in "mabc"]))
    assert [r[0] for r in got] == [True, False, True, False, False]


@pytest.mark.parametrize(("query", "hits"), [("scotia nova", {1}), ("[.*", set()), ("ＨＡＬＩＦＡＸ", {2}), ("", {1, 2, 3}), ("budget  scotia", {1})])
def test_words_in_compatibility_form(spark, query, hits):
    df = spark.createDataFrame([(1, "Nova Scotia Budget"), (2, "HALIFAX"), (3, None)], "id int, title string")
    assert {r.id for r in df.where(text.all_words(query, "title")).collect()} == hits


def test_phrases(spark):
    df = spark.createDataFrame([(1, "red", "bolt"), (2, "red bolt", None), (3, None, None)], "id int, a string, b string")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(text.any_field(" Red Bolt ", "a", "b")) == [2]
    assert ids(text.across_fields("red bolt", "a", "b")) == [1, 2]
    assert ids(text.one_field("ed", "a")) == [1, 2]
    assert ids(text.any_field("", "a")) == [1, 2, 3]


def test_urls(spark):
    raw = ["https://a.b/c?d=1#e", "http://a.b", "https://u:p@a.b/", "https:///x", "nonsense", None, "HTTPS://a.b"]
    assert [x is not None for x in one(spark, raw, urls.safe_url(F.col("x")))] == [True, False, False, False, False, False, True]
    assert one(spark, raw[:1], urls.without_query(F.col("x"))) == ["https://a.b/c#e"]


def test_routes(spark):
    raw = ["#/", "#/find?q=1", "#/record/a%20b", "#/investigation/x?depth=detail", "#/investigation/x?depth=other", "#/nowhere", "#/find/extra", "#/transit", "#/water-projects"]
    got = one(spark, raw, urls.route(F.col("x")))
    assert [tuple(r) for r in got] == [("home", None, None), ("find", None, None), ("record", "a b", None), ("investigation", "x", "detail"), ("investigation", "x", "simple"), ("not-found", None, None), ("not-found", None, None), ("transit", None, None), ("water-projects", None, None)]


def test_closed_keys(spark):
    raw = ['{"a":1,"b":2}', '{"b":2,"a":1}', '{"a":1}', '{"a":1,"b":2,"c":3}', '{"a":1,"a":2,"b":2}', "[1]", "x", None]
    assert one(spark, raw, hashing.has_keys(F.col("x"), "b", "a")) == [True, True] + [False] * 6
    assert one(spark, raw[3:4], hashing.extra_keys(F.col("x"), "a")) == [["b", "c"]]


def test_canonical_json(spark):
    got = one(spark, ['{"b": 1, "a": [1, 2]}', '{"a":[1,2],"b":1}', "x", None], hashing.canonical_sha256(F.col("x")))
    assert got[0] == got[1] is not None
    assert got[2:] == [None, None]
    assert one(spark, [3], hashing.pointer("records", F.col("x"), "value"), "x int") == ["/records/3/value"]
