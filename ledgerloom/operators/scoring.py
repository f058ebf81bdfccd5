"""Scores of candidate edges in basis points: each feature is rounded half-even, then they are added."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from . import candidates
from .policy import Band, Matching

FIELDS = ["reference", "instrument", "side", "currency", "quantity", "unit_price", "gross_amount", "executed_at", "state"]
#: What follows a field's name where its number is a bigint, and what edges carry.
SMALL = "_small"
CARRIED = [*FIELDS, *(f"{c}{SMALL}" for c in ("quantity", "unit_price", "gross_amount"))]


def with_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` (left_id, right_id) with both records' fields as l_* and r_*."""
    fields = FIELDS + [c for c in ("alias",) if c in records.columns]
    left = records.select(F.col("id").alias("left_id"), *[F.col(c).alias(f"l_{c}") for c in fields])
    right = records.select(F.col("id").alias("right_id"), *[F.col(c).alias(f"r_{c}") for c in fields])
    return pairs.join(left, "left_id").join(right, "right_id")


def _both(name: str) -> Column:
    return F.col(f"l_{name}").isNotNull() & F.col(f"r_{name}").isNotNull()


def contradictions(policy: Matching = Matching()) -> Column:
    """Sorted codes of the fields that both records have and that differ. Aliases count only if references are local to their sources."""
    key, code = ("reference", "SHARED_REFERENCE_MISMATCH") if policy.reference_contract == "SHARED_MUST_AGREE" else ("alias", "SHARED_ALIAS_MISMATCH")
    codes = {"currency": "CURRENCY_MISMATCH", "instrument": "INSTRUMENT_MISMATCH", key: code, "side": "SIDE_MISMATCH"}
    return F.array_compact(F.array(*[F.when(_both(c) & (F.col(f"l_{c}") != F.col(f"r_{c}")), F.lit(code)) for c, code in codes.items()]))


def coverage_failures() -> Column:
    """Sorted codes of the fields that one of the records lacks; of price and amount one is enough."""
    lacks = {
        "MISSING_CURRENCY": ~_both("currency"), "MISSING_INSTRUMENT": ~_both("instrument"), "MISSING_MONETARY_FIELD": ~(_both("unit_price") | _both("gross_amount")),
        "MISSING_QUANTITY": ~_both("quantity"), "MISSING_SIDE": ~_both("side"), "MISSING_TIMESTAMP": ~_both("executed_at"),
    }
    return F.array_compact(F.array(*[F.when(gone, F.lit(code)) for code, gone in lacks.items()]))


def prepared(records: DataFrame) -> DataFrame:
    """``records`` with their numbers as bigints too, where those hold them: once for each record, not for each edge."""
    return records.withColumns({f"{c}{SMALL}": exact.small(F.col(c)) for c in Matching().bands})


def carried(records: DataFrame) -> list[str]:
    """The columns of ``prepared`` records that an edge's scores and codes are made of."""
    return [*CARRIED, *(c for c in ("alias",) if c in records.columns)]


def scored_edges(remaining: DataFrame, policy: Matching, rejected: DataFrame | None = None) -> DataFrame:
    """``candidates.edges`` with the fields of both records and their scores, made where the records meet: nothing of an edge is shuffled or kept."""
    return scores(candidates.edges(prepared(remaining), policy, rejected, carried(remaining)), policy)


def _in_bigints(weight: int, band: Band) -> tuple[int, int, int] | None:
    """Border in hundredths of 1e-4 (fixed part, hundredths of the larger value) and the largest value whose products fit into 64 bits; None if the fixed part is finer or too large."""
    fixed, hundredths = Decimal(band.absolute) * 10**6, Decimal(band.relative) * 100
    if fixed % 1 or hundredths % 1 or fixed * max(weight, 1) >= 2**62:
        return None
    return int(fixed), int(hundredths), min(2**62 // 200, 2**62 // max(1, weight * int(hundredths)))


def _slow(weight: int, band: Band, left: Column, right: Column) -> Column:
    """The share in exact decimals, as a lambda: it is run for the few edges that need it, and keeps its code out of the others'."""

    def one(x: Column) -> Column:
        l, r = x["l"], x["r"]
        return exact.share(weight, F.abs((exact.units(l) - exact.units(r)).cast("decimal(38,0)")), exact.band(l, r, band.absolute, band.relative))

    return F.get(F.transform(F.array(F.struct(left.alias("l"), right.alias("r"))), one), F.lit(0))


def scores(pairs: DataFrame, policy: Matching) -> DataFrame:
    """Adds a column for each feature, ``score``, ``contradicted`` and ``covered``. A feature with a missing value gives 0.

    Numbers that fit are counted in bigints, step by step, so that no step holds the code of another; others in decimals."""
    c, zero = F.col, F.lit(0).cast("bigint")
    kept = [*pairs.columns]
    more = {f"{side}_{name}{SMALL}": exact.small(c(f"{side}_{name}")) for name in policy.bands for side in "lr" if f"{side}_{name}{SMALL}" not in kept}
    borders, gaps, whole = {}, {}, {}
    for name, b in policy.bands.items():
        l, r, fits = c(f"l_{name}{SMALL}"), c(f"r_{name}{SMALL}"), _in_bigints(policy.weights[name], b)
        if fits is None:
            borders[f"border_{name}"], gaps[f"gap_{name}"] = F.lit(None).cast("bigint"), zero
            continue
        fixed, hundredths, most = fits
        border = F.greatest(F.lit(fixed).cast("bigint"), F.lit(hundredths).cast("bigint") * F.greatest(F.abs(l), F.abs(r)))
        borders[f"border_{name}"] = F.when(l.between(-most, most) & r.between(-most, most), border)
        gaps[f"gap_{name}"] = F.when(c(f"border_{name}").isNotNull(), F.abs(l - r) * 100)
    apart = F.abs(F.unix_micros("l_executed_at") - F.unix_micros("r_executed_at"))
    out = pairs.withColumns(more).withColumns(borders).withColumns(gaps | {"gap_timestamp": apart})
    tops = {f"top_{name}": F.greatest(zero, c(f"border_{name}") - c(f"gap_{name}")) * policy.weights[name] for name in policy.bands}
    time, weight = policy.time_band_seconds * 1_000_000, policy.weights["timestamp"]
    in_time = 0 < time * max(weight, 1) < 2**62
    out = out.withColumns(tops | {"top_timestamp": F.greatest(zero, F.lit(time).cast("bigint") - c("gap_timestamp")) * weight if in_time else zero})
    for name, b in policy.bands.items():
        l, r, border = c(f"l_{name}"), c(f"r_{name}"), c(f"border_{name}")
        quick = exact.small_share(policy.weights[name], c(f"top_{name}"), border)
        whole[f"{name}_bp"] = F.when(l.isNull() | r.isNull(), F.lit(0)).when(border > 0, quick).when(border == 0, F.when(c(f"gap_{name}") == 0, policy.weights[name]).otherwise(0)).otherwise(_slow(policy.weights[name], b, l, r))
    band = F.lit(time)
    share = exact.small_share(weight, c("top_timestamp"), band.cast("bigint")) if in_time else exact.share(weight, c("gap_timestamp").cast("decimal(38,0)"), band.cast("decimal(38,0)"))
    whole["timestamp_bp"] = F.when(c("gap_timestamp").isNull(), F.lit(0)).otherwise(share)
    # as it is, no filter on scores is moved below this step, where it would be written out in full once more
    total = c("quantity_bp") + c("timestamp_bp") + c("unit_price_bp") + c("gross_amount_bp") + F.spark_partition_id() * 0
    key = "reference" if policy.reference_contract == "SHARED_MUST_AGREE" else "alias"
    differs = [F.coalesce(c(f"l_{x}") != c(f"r_{x}"), F.lit(False)) for x in ("currency", "instrument", key, "side")]
    covered = [_both(x) for x in ("currency", "instrument", "quantity", "side", "executed_at")]
    out = out.withColumns(whole).withColumns({"score": total, "contradicted": reduce(or_, differs), "covered": reduce(and_, covered) & (_both("unit_price") | _both("gross_amount"))})
    features = ["quantity_bp", "unit_price_bp", "gross_amount_bp", "timestamp_bp", "score", "contradicted", "covered"]
    return out.select(*[x for x in kept if not x.endswith(SMALL)], *features)
