"""Exact numbers: decimals kept as text, source tokens, cents, scaling. Missing is never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = r"\A-?[0-9]+(\.[0-9]+)?\z"
CENTS = r"\A[0-9]+\.[0-9]{2}\z"
AMOUNT = r"\A-?(0|[1-9][0-9]*)\.[0-9]{2}\z"
#: Largest integer that a double holds exactly, the bound for displayed amounts (fixed value).
SAFE = (1 << 53) - 1
#: Dollars in one source unit (fixed values).
MULTIPLIER = {"CAD_thousands": 1_000, "CAD_millions": 1_000_000}


def holds(condition: Column) -> Column:
    """A condition in which unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def is_decimal(raw: Column, longest: int = 80) -> Column:
    """M2: plain decimal text of bounded length; no exponent, comma, sign plus or white space."""
    return holds(raw.rlike(DECIMAL) & (F.length(raw) <= longest))


def to_decimal(raw: Column, scale: int = 6) -> Column:
    """Value of decimal text, or null if it is none or does not fit 38 digits at this scale without rounding."""
    places = F.length(F.regexp_extract(raw, r"\.([0-9]+)\z", 1))
    return F.when(is_decimal(raw) & (places <= scale), raw.try_cast(f"decimal(38,{scale})"))


def cents(raw: Column) -> Column:
    """A3, A4: exact dollars and cents of ``1234.50``; anything else is null."""
    return F.when(raw.rlike(CENTS), raw.try_cast("decimal(38,2)"))


def decimal_text(value: Column) -> Column:
    """Decimal as fixed-scale text, without an exponent."""
    return value.cast("string")


def source_token(token: Column, dash: str = "-") -> Column:
    """What a printed cell says: struct of presence and exact text.

    ``(1,234)`` is negative; the dash and the empty cell are kept apart and have no value; text that is
    no number is ``malformed``.
    """
    bare = F.regexp_replace(token, ",", "")
    inner = F.regexp_extract(bare, r"\A\((.*)\)\z", 1)
    value = F.when(bare.startswith("("), F.concat(F.lit("-"), inner)).otherwise(bare)
    presence = (
        F.when(token.isNull(), "missing").when(token == "", "blank").when(token == dash, "source_dash").when(is_decimal(value), "present").otherwise("malformed")
    )
    return F.struct(presence.alias("presence"), F.when(presence == "present", value).alias("value"))


#: Characters of decimal text that is scaled (fixed value), and digits in a limb.
MOST_SCALED, LIMB = 128, 9
#: Characters of text whose product with a factor of the safe range has at most 38 digits.
SHORT = 22


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scale_exact(raw: Column, multiplier: Column) -> Column:
    """Text of at most 128 characters times a whole number of the safe range: a whole number in the safe range, else null.

    The digits of text of up to 22 characters are one decimal; those of longer text are multiplied in limbs of nine, from the last, with a carry. So nothing
    is rounded whatever their number. The product is whole if its last digits, as many as the text has after the point, are zeros.
    """
    factor = multiplier.try_cast("decimal(16,0)")
    digits, places = F.regexp_replace(raw, r"[-.]", ""), F.length(F.regexp_extract(raw, r"\.([0-9]+)\z", 1))
    product = F.when(F.length(raw) <= SHORT, (digits.try_cast(f"decimal({SHORT},0)") * factor).cast("string")).otherwise(_long_product(digits, factor))

    def whole(made: Column) -> Column:
        kept = F.length(made) - places
        value = F.when(kept > 0, F.regexp_replace(F.substring(made, F.lit(1), kept), r"\A0+(?=.)", "").try_cast("decimal(38,0)")).otherwise(0)
        return F.when(~F.substring(made, F.greatest(kept, F.lit(0)) + 1, places).rlike("[1-9]"), value)

    fits = is_decimal(raw, MOST_SCALED) & factor.between(1, SAFE)
    signed = lambda v: F.when(v <= SAFE, F.when(raw.startswith("-"), -v).otherwise(v)).cast("long")
    return _once(F.when(holds(fits), product), lambda made: _once(whole(made), signed))


def _long_product(digits: Column, factor: Column) -> Column:
    """Text of digits times a factor of at most 16 digits, in limbs."""
    limbs = MOST_SCALED // LIMB + 1
    parts = F.transform(F.reverse(F.regexp_extract_all(F.lpad(digits, limbs * LIMB, "0"), F.lit(f"[0-9]{{{LIMB}}}"), 0)), lambda limb: limb.try_cast("decimal(9,0)"))
    one = F.lit(10**LIMB).cast("decimal(10,0)")

    def step(s: Column, limb: Column) -> Column:
        total = (limb * factor + s["carry"]).cast("decimal(27,0)")
        low = (total % one).cast("decimal(9,0)")
        return F.struct(F.concat(F.lpad(low.cast("string"), LIMB, "0"), s["text"]).alias("text"), ((total - low) / one).cast("decimal(18,0)").alias("carry"))

    return F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit(0).cast("decimal(18,0)").alias("carry")), step, lambda s: F.concat(s["carry"].cast("string"), s["text"]))


def multiplier_of(unit: Column) -> Column:
    """Dollars in a unit; null for units that are not known."""
    return F.coalesce(*[F.when(unit == u, F.lit(m)) for u, m in MULTIPLIER.items()])


def in_bound(raw: Column, bound: int = 10_000_000_000) -> Column:
    """Two decimals, no leading zeros, at most 32 characters, within the bound."""
    return holds(raw.rlike(AMOUNT) & (F.length(raw) <= 32) & (F.abs(raw.try_cast("decimal(38,2)")) <= bound))


def grouped(raw: Column) -> Column:
    """Thousands separators in the whole part of decimal text; other text is not established."""
    whole = F.regexp_replace(F.substring_index(raw, ".", 1), r"\B(?=([0-9]{3})+(?![0-9]))", ",")
    rest = F.regexp_extract(raw, r"(\.[0-9]+)\z", 1)
    return F.when(is_decimal(raw, 1 << 20), F.concat(whole, rest)).otherwise("Not established")


def display_money(value: Column, places: int = 0) -> Column:
    """Dollars for display; null and non-finite values are not established."""
    known = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < float("inf"))
    shown = F.format_number(F.abs(value), places)
    return F.when(known, F.concat(F.when(value < 0, "-$").otherwise("$"), shown)).otherwise("Not established")


def hundred_thousands(label: Column) -> Column:
    """``$12.3`` million as whole dollars, from the text alone."""
    digits = F.regexp_extract(label, r"\A\$([0-9]+\.[0-9])\z", 1)
    return F.when(digits != "", (F.regexp_replace(digits, r"\.", "").cast("long") * 100_000))


def sum_known(value: Column) -> Column:
    """A sum only if no input is missing and there is one; ``sum`` alone would skip nulls."""
    return F.when((F.count_if(value.isNull()) == 0) & (F.count(F.lit(1)) > 0), F.sum(value))


def rounded_percent_holds(percent: Column, part: Column, whole: Column) -> Column:
    """Whether an integer percentage is part / whole rounded to the nearest point."""
    return holds(F.abs(percent * whole - part * 100) * 2 <= whole)
