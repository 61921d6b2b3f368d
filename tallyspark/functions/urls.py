"""URL gates and the reading of page addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import holds

#: Pages that stand alone, and pages that name one record (fixed values).
PAGES = (
    "transit", "hrm-winter", "hrm-facilities", "hrm-capital", "find", "money", "sources", "methods", "tenders", "municipal", "municipal-capital", "capital-explanation", "health-spending", "richmond-register",
    "water-projects", "shelburne-grants", "audits", "budget-tables", "transfers", "institution", "authorizations", "cash-bridge",
)
RECORD_PAGES = ("record", "investigation", "governance", "authorization-trace", "reporting-question")


def safe_url(url: Column) -> Column:
    """The URL if it is https with a host and without user information, else null."""
    fine = (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0) & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    return F.when(holds(fine), url)


def without_query(url: Column) -> Column:
    """A link to share: origin, path and fragment, the query dropped."""
    return F.regexp_replace(url, r"\?[^#]*", "")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def route(address: Column) -> Column:
    """Struct of page, record id and depth of ``#/page/id?depth=…``; unknown pages are ``not-found``."""
    path = F.regexp_replace(F.substring_index(address, "?", 1), r"\A#?/?", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first, n = F.try_element_at(parts, F.lit(1)), F.size(parts)
    page = F.when(n == 0, "home").when((n == 1) & first.isin(*PAGES), first).when((n == 2) & first.isin(*RECORD_PAGES), first).otherwise("not-found")
    depth = F.regexp_extract(address, r"[?&]depth=(simple|detail|evidence)(?:&|\z)", 1)
    return F.struct(
        page.alias("page"),
        F.when(page.isin(*RECORD_PAGES), F.try_url_decode(F.try_element_at(parts, F.lit(2)))).alias("id"),
        F.when(page == "investigation", F.when(depth == "", "simple").otherwise(depth)).alias("depth"),
    )
