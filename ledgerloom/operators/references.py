"""First stage: reviewers' decisions and unique trusted references settle records before any score is built.

Precedence: cancelled, manual link (or attention, if the other end is cancelled), accepted as unmatched, reserved by a
reviewer (or by a link whose other end is no record here), duplicate reference, pair by a reference that occurs once on each side; the others remain. References
are counted by an aggregation that is combined before the shuffle, so a very frequent one is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Decisions:
    """links, rejected: left_id, right_id. accepted, reserved: id."""

    links: DataFrame | None = None
    accepted: DataFrame | None = None
    rejected: DataFrame | None = None
    reserved: DataFrame | None = None


@dataclass
class Preprocessed:
    """outcomes: rec_side, id, outcome, partner (every record). remaining: the records whose outcome is REMAINING."""

    outcomes: DataFrame
    remaining: DataFrame
    pairs: DataFrame


def _marked(records: DataFrame, ids: DataFrame | None, name: str) -> DataFrame:
    if ids is None:
        return records.withColumn(name, F.lit(False))
    held = ids.select(F.col("id").alias("marked_id")).distinct()
    return records.join(held, F.col("id") == F.col("marked_id"), "left").withColumn(name, F.col("marked_id").isNotNull()).drop("marked_id")


def _present(links: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links whose ends are both among ``records``, and the present ends (id) of the others."""
    ids = records.select("id")
    found = links.select("left_id", "right_id").distinct()
    for end in ("left", "right"):
        found = found.join(ids.withColumnRenamed("id", f"{end}_found"), F.col(f"{end}_id") == F.col(f"{end}_found"), "left")
    both = F.col("left_found").isNotNull() & F.col("right_found").isNotNull()
    alone = found.where(~both).select(F.coalesce("left_found", "right_found").alias("id")).where("id is not null")
    return found.where(both).select("left_id", "right_id"), alone


def preprocess(records: DataFrame, decisions: Decisions = Decisions()) -> Preprocessed:
    """``records``: rec_side (L or R), id, reference, state and the fields to match on."""
    known = records.select("rec_side", "id", "reference", "state")
    links, reserved = decisions.links, decisions.reserved
    if links is not None:
        links, alone = _present(links, known)
        reserved = alone if reserved is None else alone.unionByName(reserved.select("id"))
    known = _marked(_marked(known, decisions.accepted, "accepted"), reserved, "reserved")
    live = known.where("state <> 'CANCELLED'").select("id")
    if links is not None:
        links = links.join(live.withColumnRenamed("id", "l_"), F.col("left_id") == F.col("l_"), "left").join(live.withColumnRenamed("id", "r_"), F.col("right_id") == F.col("r_"), "left")
        both = F.col("l_").isNotNull() & F.col("r_").isNotNull()
        ends = F.explode(F.array(F.struct(F.col("l_").alias("link_id"), F.col("r_").alias("other")), F.struct(F.col("r_").alias("link_id"), F.col("l_").alias("other")))).alias("end")
        ends = links.select(both.alias("both"), ends).select("both", "end.*").where("link_id is not null")
        known = known.join(ends, F.col("id") == F.col("link_id"), "left").drop("link_id")
    else:
        known = known.withColumn("both", F.lit(None).cast("boolean")).withColumn("other", F.lit(None).cast("string"))
    first = F.when(F.col("state") == "CANCELLED", "CANCELLED").when(F.col("both"), "MANUAL_PAIR").when(~F.col("both"), "MANUAL_ATTENTION").when(F.col("accepted"), "ACCEPTED_UNMATCHED").when(F.col("reserved"), "REVIEWER_RESERVED")
    known = known.withColumn("early", first)

    open_ = known.where("early is null and reference is not null")
    left = F.col("rec_side") == "L"
    keys = open_.groupBy(F.col("reference").alias("key")).agg(
        F.count(F.when(left, 1)).alias("n_left"), F.count(F.when(~left, 1)).alias("n_right"), F.min(F.when(left, F.col("id"))).alias("left_id"), F.min(F.when(~left, F.col("id"))).alias("right_id")
    )
    keys = keys.where("n_left > 1 or n_right > 1 or (n_left = 1 and n_right = 1)")
    if decisions.rejected is not None:
        no = decisions.rejected.select("left_id", "right_id").distinct().withColumn("prohibited", F.lit(True))
        keys = keys.join(no, ["left_id", "right_id"], "left").where("n_left > 1 or n_right > 1 or prohibited is null")
    keys = keys.withColumn("twice", (F.col("n_left") > 1) | (F.col("n_right") > 1))
    # records without a reference meet nothing; a key of their own spreads them
    own = F.coalesce(F.when(F.col("early").isNull(), F.col("reference")), F.concat(F.lit("\u0000"), F.col("id")))
    known = known.withColumn("own_key", own).join(keys.select("key", "twice", "left_id", "right_id"), F.col("own_key") == F.col("key"), "left")
    outcome = F.coalesce("early", F.when(F.col("twice"), "DUPLICATE_REFERENCE").when(~F.col("twice"), "REFERENCE_PAIR").otherwise("REMAINING"))
    partner = F.when(F.col("early") == "MANUAL_PAIR", F.col("other")).when(F.col("early").isNull() & ~F.col("twice"), F.when(left, F.col("right_id")).otherwise(F.col("left_id")))
    outcomes = known.select("rec_side", "id", outcome.alias("outcome"), partner.alias("partner"))
    pairs = outcomes.where("rec_side = 'L' and partner is not null").select(F.col("id").alias("left_id"), F.col("partner").alias("right_id"), F.col("outcome").alias("origin"))
    rest = outcomes.where("outcome = 'REMAINING'").select("id")
    return Preprocessed(outcomes, records.join(rest, "id", "left_semi"), pairs)
