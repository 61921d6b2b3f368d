"""The filters of each collection (F3 to F18): what a search reads, and what a bad argument does, is declared for each in one place.

Arguments are checked before rows are handed out. Columns are snake-case; empty arguments are no filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import search
from .joins import label


@dataclass(frozen=True)
class Searched:
    """What the search of a collection reads: ``fields`` by ``how`` (``words``, ``plain_words``, ``any``, ``across``), the last ``labels`` of them joined on ``on``.

    ``known`` names the columns whose values a filter may ask for: another value is an error.
    """

    how: str
    fields: tuple[str, ...]
    on: str | None = None
    labels: tuple[str, ...] = ()
    known: tuple[str, ...] = ()

    def matches(self, query: str):
        ways = {"words": text.all_words, "plain_words": lambda q, *f: text.all_words(q, *f, nfkc=False), "any": text.any_field, "across": text.across_fields}
        return ways[self.how](query, *self.fields) if query.strip() else F.lit(True)

    def filed(self, rows: DataFrame, query: str, parents: DataFrame | None = None, **columns) -> DataFrame:
        """The rows that the query finds and whose columns have the values; the joined labels come with them for the search alone."""
        for name, value in columns.items():
            if name in self.known and value not in ("", None) and (parents if name == self.on else rows).where(F.col(name) == F.lit(value)).isEmpty():
                raise ValueError(f"unknown {name}: {value!r}")
        if not self.labels:
            return search.filed(rows, query, self.matches(query), **columns)
        named = {f: f"__{f}" for f in self.labels}
        own = parents.select(self.on, *[F.col(f).alias(n) for f, n in named.items()])
        own_fields = Searched(self.how, tuple(named.get(f, f) for f in self.fields))
        return search.filed(label(rows, own, [self.on], list(named.values())), query, own_fields.matches(query), **columns).select(rows.columns)


REFERENCES = Searched("words", ("id", "title", "group", "jurisdiction", "url"))
MONEY = Searched("words", ("title", "entity", "metric", "stage"))
PHYSICIAN = Searched("any", ("id", "type", "subcategory"), known=("year", "type"))
REGISTER = Searched("any", ("id", "vendor", "vendor_id", "cheque_number"))
BUDGET = Searched("across", ("label", "section", "id"))
RECOMMENDATIONS = Searched("any", ("id", "number", "title", "business_unit"), on="audit_id", labels=("title",), known=("audit_id",))
TRANSIT = Searched("plain_words", ("id", "year", "measure", "label"), on="group_id", labels=("label",))
WATER = Searched("words", ("project_name", "project_number", "matter_text"))
#: Statuses of a recommendation, and sections of the register (fixed values).
STATUSES = ("Completed", "Incomplete")
SECTIONS = ("GENERAL", "ONLINE UTILITY", "WATER", "ONLINE PAYMENTS")


def references(rows: DataFrame, query: str = "", group: str = "", stage: str = "") -> DataFrame:
    """by words; stage is published, reference or capture, others mean any."""
    kept = search.equals("group", group)
    if stage == "published":
        kept = kept & F.col("published")
    elif stage == "reference":
        kept = kept & ~F.col("published")
    elif stage == "capture":
        kept = kept & F.col("capture").isNotNull()
    return REFERENCES.filed(rows, query).where(kept)


def money(rows: DataFrame, query: str = "", stage: str = "") -> DataFrame:
    """facts by words, of which the stage is searched too, and by stage."""
    return MONEY.filed(rows, query, stage=stage)


def municipal(rows: DataFrame, query: str = "", type: str = "", year: str = "") -> DataFrame:
    """a phrase in the municipality (T5), type and year; unknown values find nothing."""
    return search.filed(rows, query, text.one_field(query, "municipality"), municipality_type=type, fiscal_year=year)


def municipal_capital(rows: DataFrame, query: str = "", type: str = "", role: str = "municipality") -> DataFrame:
    """municipalities or published aggregates by words in any order (T1), never both; an unknown role means municipalities."""
    role = role if role == "published_aggregate" else "municipality"
    return search.filed(rows, query, text.all_words(query, "municipality"), municipality_type=type, row_role=role)


def physician(rows: DataFrame, query: str = "", year: str = "", type: str = "", sign: str = "") -> DataFrame:
    """a phrase in the id or a label, year, type, and negative or zero amounts; another sign is an error, and so is a year or type that no row has."""
    search.check_choice(sign, ("negative", "zero"))
    status = {"negative": "negative_reported_value", "zero": "explicit_zero"}.get(sign, "")
    return PHYSICIAN.filed(rows, query, year=year, type=type, amount_status=status)


def register(rows: DataFrame, query: str = "", section: str = "", low: str = "", high: str = "", month: str = "2026-01", sections: Sequence[str] = SECTIONS) -> DataFrame:
    """F8: cheques of the one month there is; a date outside it is an error, as are an unordered range and a section that is none of ``sections``."""
    search.check_choice(section, sections)
    search.check_range(low, high)
    for d in (low, high):
        if d and not d.startswith(month + "-"):
            raise ValueError(f"{d} is not in {month}")
    return REGISTER.filed(rows, query, section=section).where(search.within("cheque_date", low, high))


def transfers(rows: DataFrame, program: str = "", year: str = "") -> DataFrame:
    """payments of a program and year in their order (SRT2)."""
    return search.payments_order(search.filed(rows, "", F.lit(True), program_code=program, fiscal_year=year))


def institution(rows: DataFrame, query: str = "", stage: str = "", type: str = "") -> DataFrame:
    """F10."""
    return search.filed(rows, query, text.one_field(query, "label"), stage=stage, measure_type=type)


def budget(rows: DataFrame, query: str = "", stage: str = "", table: str = "") -> DataFrame:
    """a phrase over label, section and id together (T4)."""
    return BUDGET.filed(rows, query, stage=stage, table=table)


def authorizations(orders: DataFrame, query: str = "", year: str = "") -> DataFrame:
    """orders keep the clauses whose entity has the phrase; orders without any go."""
    phrase = query.strip().lower()
    kept = search.children(orders, "records", lambda r: F.contains(F.lower(F.coalesce(r["entity"], F.lit(""))), F.lit(phrase)))
    return kept.where(search.equals("fiscal_year", year))


def audits(rows: DataFrame, query: str = "", year: int | None = None, incomplete: bool = False) -> DataFrame:
    """a phrase over organization and title together (T4), year, and audits with something left to do."""
    kept = search.filed(rows, query, text.across_fields(query, "organization", "title"), year=year)
    return kept.where("not_completed > 0") if incomplete else kept


def audit_recommendations(rows: DataFrame, audits_: DataFrame, query: str = "", audit: str = "", status: str = "") -> DataFrame:
    """Recommendations by a phrase in the id, the number, the title of their audit (``audits_``: audit_id, title) or the business unit; an unknown audit or status is an error."""
    search.check_choice(status, STATUSES)
    return RECOMMENDATIONS.filed(rows, query, audits_, audit_id=audit, status=status)


def groups(rows: DataFrame, groups_: DataFrame, query: str = "", group: str = "", *fields: str) -> DataFrame:
    """facilities, winter and capital rows by a phrase in the id, any of the fields, or the label of their group (``groups_``: group_id, label), and by group."""
    return Searched("any", ("id", *fields, "label"), on="group_id", labels=("label",)).filed(rows, query, groups_, group_id=group)


def transit(rows: DataFrame, groups_: DataFrame, query: str = "", group: str = "", year: str = "") -> DataFrame:
    """F16: words without the compatibility form (T6) over id, year, measure and the label of the group; group and year."""
    return TRANSIT.filed(rows, query, groups_, group_id=group, year=year)


def water(rows: DataFrame, query: str = "", service: str = "") -> DataFrame:
    """words (T1) over a project's name and number and the text of its matters, and the service."""
    return WATER.filed(rows, query, service_group=service)
