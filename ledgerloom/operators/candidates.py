"""Candidate edges: equal block keys and times at most a window apart (both ends included).

The time range is made an equi-join: the left record has its bucket of one window's width, the right record meets
the bucket and both neighbours. So a block (a hot instrument) is spread over its buckets.

Edges grow with the square of a block, records don't: fields that edges need are carried by the records through the join, and edges
are not shuffled, but for those of left records that have a rejection.

Caps need an order (see ``passes`` and ``reach``). A block's edges are numbered in three levels (its time slots, the left records
of a slot, the edges of a left record), so no task sorts a whole block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .policy import Matching


def block_key(policy: Matching) -> Column:
    return F.to_json(F.array(*[F.col(c) for c in policy.block_on]))


def unrejected(left: DataFrame, met: Callable[[DataFrame], DataFrame], rejected: DataFrame | None) -> DataFrame:
    """``met(left)`` (with left_id, right_id) without the edges of ``rejected``. ``left``: left_id and what ``met`` joins on."""
    if rejected is None:
        return met(left)
    no = rejected.select("left_id", "right_id").distinct()
    some = no.select(F.col("left_id").alias("no_id")).distinct()
    marked = left.join(some, F.col("left_id") == F.col("no_id"), "left")
    free, bound = (met(marked.where(f"no_id is {x}null").drop("no_id")) for x in ("", "not "))
    return free.unionByName(bound.join(no, ["left_id", "right_id"], "left_anti"))


def edges(remaining: DataFrame, policy: Matching, rejected: DataFrame | None = None, carry: Iterable[str] = ()) -> DataFrame:
    """left_id, right_id, block, left_at, right_at of all pairs of remaining records that block and window allow, with both records' fields ``carry`` as l_* and r_*."""
    w = policy.window_seconds * 1_000_000
    held = remaining.where(" and ".join([f"{c} is not null" for c in policy.block_on] + ["executed_at is not null"]))
    held = held.select("rec_side", "id", block_key(policy).alias("block"), F.unix_micros("executed_at").alias("at"), *[F.col(c).alias(f"own_{c}") for c in carry])
    own = lambda side: [F.col(f"own_{c}").alias(f"{side}_{c}") for c in carry]
    bucket = F.floor(F.col("at") / F.lit(max(w, 1))).cast("bigint")
    left = held.where("rec_side = 'L'").select(F.col("id").alias("left_id"), "block", F.col("at").alias("left_at"), bucket.alias("bucket"), *own("l"))
    near = F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket")
    right = held.where("rec_side = 'R'").select(F.col("id").alias("right_id"), "block", F.col("at").alias("right_at"), near, *own("r"))
    out = unrejected(left, lambda some: some.join(right, ["block", "bucket"]).where(F.abs(F.col("left_at") - F.col("right_at")) <= w), rejected)
    return out.select("left_id", "right_id", "block", "left_at", "right_at", *[f"{side}_{c}" for side in "lr" for c in carry])


def numbered(found: DataFrame, one: Column, window_seconds: int | None) -> DataFrame:
    """``found`` with ``of_left`` and ``nth``: the running sums of ``one`` over the edges of a left record, and over those of a block by (left_at, left_id, right_at, right_id)."""

    def before(c: str, *by: str) -> Column:
        inside = Window.partitionBy("block", *by[:-1]).orderBy(*by[-1].split()).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(c).over(inside), F.lit(0))

    slot = F.floor(F.col("left_at") / F.lit(max((window_seconds or 0) * 1_000_000, 1))).cast("bigint")
    lefts = found.groupBy("block", slot.alias("slot"), "left_at", "left_id").agg(F.sum(one).alias("c"))
    slots = lefts.groupBy("block", "slot").agg(F.sum("c").alias("c")).select("block", "slot", before("c", "slot").alias("slot_start"))
    lefts = lefts.withColumn("own_start", before("c", "slot", "left_at left_id")).join(slots, ["block", "slot"])
    starts = lefts.select(F.col("block").alias("block_"), F.col("left_id").alias("left_"), (F.col("slot_start") + F.col("own_start")).alias("start"))
    own = Window.partitionBy("block", "left_id").orderBy("right_at", "right_id").rowsBetween(Window.unboundedPreceding, 0)
    held = found.withColumn("of_left", F.sum(one).over(own)).join(starts, (F.col("block") == F.col("block_")) & (F.col("left_id") == F.col("left_")))
    return held.withColumn("nth", F.col("start") + F.col("of_left")).drop("block_", "left_", "start")

