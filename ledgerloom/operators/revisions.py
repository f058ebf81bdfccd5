"""Dataset revisions: full snapshots and deltas over a base, duplicate keys, and digests that know equal states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact


def merged(base: DataFrame, delta: DataFrame, key: str = "source_record_key", operation: str = "operation", state: str = "state") -> DataFrame:
    """``base`` after UPSERT and CANCEL (both put the delta's whole record in place, for a known key or a new one; a cancelled
    record's state is CANCELLED) and RETRACT (removes; unknown keys are no matter).

    Keys of ``delta`` are unique. A key that the delta leaves out stays."""
    others = [c for c in base.columns if c != key]
    new = delta.select(F.col(key).alias("key_"), F.col(operation).alias("op_"), *[F.col(c).alias(f"new_{c}") for c in others])
    both = base.join(new, F.col(key) == F.col("key_"), "full_outer")
    put = F.coalesce(F.col("op_").isin("UPSERT", "CANCEL"), F.lit(False))
    new_of = lambda c: F.when(F.col("op_") == "CANCEL", F.lit("CANCELLED")).otherwise(F.col(f"new_{c}")) if c == state else F.col(f"new_{c}")
    values = [F.when(put, new_of(c)).otherwise(F.col(c)).alias(c) for c in others]
    both = both.where(put | F.col("op_").isNull())
    return both.select(F.coalesce(key, "key_").alias(key), *values).select(*base.columns)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row holds, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def state_digests(rows: DataFrame, by: list[str], columns: list[str], digits: int = 2) -> DataFrame:
    """One digest for each group, whatever the order of its rows; repeated rows count.

    Rows are digested, then sorted digests of each of 16 ** ``digits`` slices, then the slices: no task sorts a whole group.
    Digests of another number of digits are others; take one more for each factor of 16 beyond some 10 million rows a group."""
    row = exact.prefixed_digest(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    held = rows.select(*by, row.alias("row_digest")).withColumn("slice", F.substring("row_digest", 1, digits))
    slices = held.groupBy(*by, "slice").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row_digest")), ""), 256).alias("d"), F.count("*").alias("c"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "d"))), lambda x: x["d"]), ""), 256)
    return slices.groupBy(*by).agg(F.sum("c").alias("n_rows"), whole.alias("digest"))


def activation(head_digest: str | None, new_digest: str, history: set[str], restore_reason: str | None = None) -> str:
    """What becomes of a prepared revision: NO_CHANGE, REPLAYED, or ACTIVATE (a restore needs a reason of 1 to 1000 characters)."""
    if restore_reason is not None and not 1 <= len(restore_reason) <= 1000:
        raise ValueError("a restore reason has 1 to 1000 characters")
    if new_digest == head_digest:
        return "NO_CHANGE"
    return "REPLAYED" if new_digest in history and restore_reason is None else "ACTIVATE"
