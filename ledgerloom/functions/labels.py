"""Texts for people: labels of codes, durations and instants, and sentences that explain a result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(code: Column) -> Column:
    """GROSS_AMOUNT as "Gross Amount"."""
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def lower(code: Column) -> Column:
    return F.lower(F.replace(code, F.lit("_"), F.lit(" ")))


def seconds(micros: Column) -> Column:
    """Microseconds as exact seconds, without trailing zeros."""
    whole = F.regexp_replace((micros.cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    return F.when(micros == 0, F.lit("0")).otherwise(whole)


def duration(micros: Column) -> Column:
    """In the largest of min, s, ms and µs that takes it whole; a dash if it is missing."""
    out = F.when(micros.isNull(), "—").when(micros == 0, "0 s")
    for unit, size in (("min", 60_000_000), ("s", 1_000_000), ("ms", 1000)):
        out = out.when(micros % size == 0, F.concat((micros / size).cast("bigint").cast("string"), F.lit(f" {unit}")))
    return out.otherwise(F.concat(micros.cast("string"), F.lit(" µs")))


def instant(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit("—"))


def candidate_sentence(candidate: Column, score: Column, partner: Column) -> Column:
    """What a diagnostic says of a candidate."""
    use = F.when(partner.isNull(), F.lit("It is free now.")).otherwise(F.concat(F.lit("It is now paired with "), partner, F.lit(".")))
    return F.concat(F.lit("Under the current policy, "), candidate, F.lit(" scores "), score.cast("string"), F.lit(" of 10000. "), use)


def comparison_sentence(field: Column, left: Column, right: Column, status: Column) -> Column:
    """What a compared field says: both values and the verdict."""
    show = lambda v: F.coalesce(v, F.lit("missing"))
    return F.concat(title(field), F.lit(": "), show(left), F.lit(" against "), show(right), F.lit(", "), lower(status), F.lit("."))
