"""Exact arithmetic over decimal(28,12): everything is done in whole units of 1e-14, so nothing is rounded unseen."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = 10**14


def units(value: Column) -> Column:
    """A decimal as a whole number of units (decimal(38,0))."""
    return (value.cast("decimal(28,12)") * F.lit(Decimal(_UNITS))).cast("decimal(38,0)")


def band(left: Column, right: Column, absolute: str, relative: str) -> Column:
    """max(absolute, relative * larger value), in units. ``relative`` has at most two decimals."""
    hundredths = int(Decimal(relative) * 100)
    if Decimal(hundredths) / 100 != Decimal(relative):
        raise ValueError("a relative band has at most two decimals")
    fixed = F.lit(Decimal(int(Decimal(absolute) * _UNITS))).cast("decimal(38,0)")
    if not hundredths:
        return fixed
    # values have 12 decimals, units 14: a hundredth of a value is whole
    part = F.greatest(F.abs(left.cast("decimal(28,12)")), F.abs(right.cast("decimal(28,12)"))) * F.lit(Decimal(hundredths * 10**12))
    return F.greatest(fixed, part.cast("decimal(38,0)"))


def share(weight: int, difference: Column, border: Column) -> Column:
    """weight * max(0, 1 - difference / border), half-even to a whole number; a border of 0 asks for equality."""
    top = F.greatest(F.lit(0).cast("decimal(38,0)"), (border - difference).cast("decimal(38,0)")) * F.lit(Decimal(weight))
    top = top.cast("decimal(38,0)")
    safe = F.when(border > 0, border).otherwise(F.lit(1).cast("decimal(38,0)"))
    whole = F.try_divide(top - top % safe, safe).cast("bigint")
    left = top % safe
    up = (2 * left > safe) | ((2 * left == safe) & (whole % 2 == 1))
    return F.when(border > 0, whole + up.cast("bigint")).otherwise(F.when(difference == 0, F.lit(weight)).otherwise(F.lit(0))).cast("int")


def small(value: Column) -> Column:
    """A decimal as a bigint in units of 1e-4; null if it has more decimals, or 13 digits before the point."""
    short = value.try_cast("decimal(16,4)")
    return F.when(short == value, (short * F.lit(Decimal(10_000))).cast("bigint"))


def small_share(weight: int, top: Column, border: Column) -> Column:
    """``share`` in bigints, of ``top`` = weight * max(0, border - difference) and a border above 0."""
    whole, left = F.call_function("div", top, border), top % border
    up = (left > border - left) | ((left == border - left) & (whole % 2 == 1))
    return (whole + up.cast("bigint")).cast("int")


def text_of(value: Column) -> Column:
    """A decimal as plain text without trailing zeros."""
    plain = value.cast("string")
    return F.when(value.isNull(), None).when(value == 0, F.lit("0")).when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)


def text_of_units(units: Column) -> Column:
    """Units of 1e-14 as plain text. Digits are cut as text, since a quotient of 38 digits would be rounded."""
    digits = F.concat(F.lit("0" * 14), F.abs(units).cast("string"))
    whole = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 14), "^0+(?=.)", "")
    part = F.regexp_replace(F.right(digits, F.lit(14)), "0+$", "")
    text = F.concat(F.when(whole == "", F.lit("0")).otherwise(whole), F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)))
    return F.when(units < 0, F.concat(F.lit("-"), text)).otherwise(text)


def instant_of(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def prefixed_digest(*values: Column) -> Column:
    """SHA-256 of texts that each follow their length in 8 bytes."""
    parts = []
    for v in values:
        raw = v.cast("string").cast("binary")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw]
    return F.sha2(F.concat(*parts), 256)


def safe_cell(value: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(F.coalesce(value, F.lit("")))
