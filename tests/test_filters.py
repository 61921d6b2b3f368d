import datetime

import pytest

from tallyspark.operators import filters


def ids(df):
    return [r.id for r in df.collect()]


def test_references(spark):
    df = spark.createDataFrame([(1, "Nova Budget", "Here", "u", "g", True, None), (2, "Other", "P", "u", "h", False, "c")], "id int, title string, jurisdiction string, url string, group string, published boolean, capture string")
    assert ids(filters.references(df, "budget nova")) == [1]
    assert [ids(filters.references(df, stage=s)) for s in ("published", "reference", "capture", "other")] == [[1], [2], [2], [1, 2]]
    assert ids(filters.references(df, group="h")) == [2] and ids(filters.references(df, "here g")) == [1] and ids(filters.references(df, "2")) == [2]


def test_municipal(spark):
    df = spark.createDataFrame([(1, "Old Harbour", "town", "2024-25", "municipality"), (2, "All towns", "town", "2024-25", "published_aggregate")], "id int, municipality string, municipality_type string, fiscal_year string, row_role string")
    assert ids(filters.municipal(df, "harbour", year="2024-25")) == [1] and ids(filters.municipal(df, type="city")) == []
    assert ids(filters.municipal_capital(df)) == [1] and ids(filters.municipal_capital(df, role="published_aggregate")) == [2] and ids(filters.municipal_capital(df, role="both")) == [1]


def test_physician(spark):
    df = spark.createDataFrame([(1, "y", "Fees", "a", "negative_reported_value"), (2, "y", "Fees", "b", "explicit_zero")], "id int, year string, type string, subcategory string, amount_status string")
    assert ids(filters.physician(df, sign="negative")) == [1] and ids(filters.physician(df, " FEES ", sign="zero")) == [2]
    with pytest.raises(ValueError):
        filters.physician(df, sign="positive")
    assert ids(filters.physician(df, "2", year="y", type="Fees")) == [2]
    for unknown in (dict(year="z"), dict(type="fees")):
        with pytest.raises(ValueError, match="unknown"):
            filters.physician(df, **unknown)


def test_register(spark):
    d = datetime.date
    df = spark.createDataFrame([(1, "V", "v77", "9", "GENERAL", d(2026, 1, 5)), (2, "W", "v5", "8", "WATER", d(2026, 1, 9)), (3, "W", "v5", "8", "WATER", None)], "id int, vendor string, vendor_id string, cheque_number string, section string, cheque_date date")
    assert ids(filters.register(df, low="2026-01-06")) == [2] and ids(filters.register(df, "w", section="WATER")) == [2, 3] and ids(filters.register(df, "V77")) == [1] and ids(filters.register(df, "3")) == [3]
    for bad in (dict(low="2026-02-01"), dict(low="2026-01-09", high="2026-01-01"), dict(high="x"), dict(section="water")):
        with pytest.raises(ValueError):
            filters.register(df, **bad)


def test_nested_and_joined(spark):
    orders = spark.createDataFrame([(1, "2024-25", [("Health", 1), ("Roads", 2)]), (2, "2024-25", [("Roads", 3)])], "id int, fiscal_year string, records array<struct<entity:string,n:int>>")
    got = filters.authorizations(orders, "HEAL").collect()
    assert [(r.id, [x.n for x in r.records]) for r in got] == [(1, [1])]
    recs = spark.createDataFrame([(1, "A", 31, "Completed", "Roads"), (2, "B", 52, "Incomplete", None)], "id int, audit_id string, number int, status string, business_unit string")
    audits = spark.createDataFrame([("A", "Winter"), ("B", "Summer")], "audit_id string, title string")
    assert ids(filters.audit_recommendations(recs, audits, "winter")) == [1] and ids(filters.audit_recommendations(recs, audits, status="Incomplete")) == [2]
    assert ids(filters.audit_recommendations(recs, audits, "52", "B")) == [2] and ids(filters.audit_recommendations(recs, audits, "road")) == [1] and filters.audit_recommendations(recs, audits, "r").columns == recs.columns
    assert ids(filters.audit_recommendations(recs, audits, "completed")) == []
    for bad in (dict(status="Maybe"), dict(audit="C")):
        with pytest.raises(ValueError):
            filters.audit_recommendations(recs, audits, **bad)


def test_the_rest(spark):
    a = spark.createDataFrame([(1, "Org", "Title", 2024, 0), (2, "Org", "Other", 2023, 3)], "id int, organization string, title string, year int, not_completed int")
    assert ids(filters.audits(a, "org title")) == [1] and ids(filters.audits(a, incomplete=True)) == [2] and ids(filters.audits(a, year=2023)) == [2]
    t = spark.createDataFrame([(1, "On time", "percent", "2024/25", "g"), (2, "Ｏn time", "percent", "2024/25", "h")], "id int, measure string, unit string, year string, group_id string")
    of = spark.createDataFrame([("g", "Ferries"), ("h", "Buses")], "group_id string, label string")
    assert ids(filters.transit(t, of, "time on")) == [1] and ids(filters.transit(t, of, "2024 bus time")) == [2] and ids(filters.transit(t, of, "percent")) == []
    assert ids(filters.groups(t, of, "time", "h", "measure")) == [2] and ids(filters.groups(t, of, "ferr", "", "measure")) == [1] and ids(filters.groups(t, of, "1", "", "measure")) == [1]
    w = spark.createDataFrame([(1, "Main", "P1", "water", "M1, M2"), (2, "Pump", "P2", "waste", None)], "id int, project_name string, project_number string, service_group string, matter_text string")
    assert ids(filters.water(w, "m2 p1")) == [1] and ids(filters.water(w, service="waste")) == [2] and filters.water(w).columns == w.columns
    p = spark.createDataFrame([("1", "A", "y", 1), ("2", "A", "z", 2), ("3", "B", "y", 3)], "id string, program_code string, fiscal_year string, payment_date int")
    assert ids(filters.transfers(p, program="A")) == ["2", "1"] and ids(filters.transfers(p, year="y")) == ["3", "1"]
    b = spark.createDataFrame([(1, "Health care", "Hospitals", "s", "t")], "id int, section string, label string, stage string, table string")
    assert ids(filters.budget(b, "hospitals health care 1")) == [1] and ids(filters.budget(b, "care hosp")) == [] and ids(filters.budget(b, table="u")) == []
    m = spark.createDataFrame([(1, "Title", "E", "m", "s")], "id int, title string, entity string, metric string, stage string")
    assert ids(filters.money(m, "m title", stage="s")) == [1] and ids(filters.money(m, "s E")) == [1]
    i = spark.createDataFrame([(1, "Cash", "audited", "stock")], "id int, label string, stage string, measure_type string")
    assert ids(filters.institution(i, "ash", type="stock")) == [1]
