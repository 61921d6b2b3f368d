"""Six text searches that differ on purpose: which normal form, words or phrase, one field or several."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def nfkc_lower():
    """Pandas UDF: compatibility normal form, lower-cased; the only step that Spark has no function for."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).lower())

    return run


def compatible(text: Column) -> Column:
    """Lower-cased compatibility form; only texts beyond ASCII go to Python, others are their own form."""
    return F.coalesce(nfkc_lower()(F.when(text.rlike(r"[^\x00-\x7f]"), text)), F.lower(text))


def folded(query: str) -> str:
    return unicodedata.normalize("NFKC", query).lower()


def joined(*fields: str) -> Column:
    """Fields laid end to end with one space; nulls count as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])


def all_words(query: str, *fields: str, nfkc: bool = True) -> Column:
    """T1 (T6 without ``nfkc``): every word of the query occurs in the joined fields; no words: all rows."""
    text = compatible(joined(*fields)) if nfkc else F.lower(joined(*fields))
    found = F.lit(True)
    for word in (folded(query) if nfkc else query.lower()).split():
        found = found & F.contains(text, F.lit(word))
    return found


def any_field(query: str, *fields: str) -> Column:
    """The whole trimmed phrase occurs in at least one field."""
    phrase = F.lit(query.strip().lower())
    found = F.lit(False)
    for f in fields:
        found = found | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), phrase)
    return found


def across_fields(query: str, *fields: str) -> Column:
    """T4: the whole trimmed phrase occurs in the joined fields, and so may span two of them."""
    return F.contains(F.lower(joined(*fields)), F.lit(query.strip().lower()))


def one_field(query: str, field: str) -> Column:
    """T5: the whole trimmed phrase occurs in the field."""
    return any_field(query, field)


def part_of(value: str, field: str) -> Column:
    """T2's second half: an optional substring of one field, in compatibility normal form."""
    return F.contains(compatible(F.coalesce(F.col(field), F.lit(""))), F.lit(folded(value))) if value else F.lit(True)


def pretty(code: Column, labels: dict[str, str] | None = None) -> Column:
    """A readable label: the given one, else the code with spaces for underscores."""
    shown = F.regexp_replace(code, "_", " ")
    for key, label in (labels or {}).items():
        shown = F.when(code == key, label).otherwise(shown)
    return shown
