"""Members of a dataset's revision: which logical record has which observation, checked before they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def problems(members: DataFrame, logicals: DataFrame, observations: DataFrame, source: str) -> DataFrame:
    """what, logical_id, observation_id: members that break a rule (none, if all is well).

    ``members``: logical_id, observation_id. ``logicals``: logical_id, source. ``observations``: observation_id, logical_id. A member's
    logical record is known and of the revision's ``source``, its observation is known and is one of that record, and a record is a member once."""
    of = observations.select(F.col("observation_id").alias("seen_"), F.col("logical_id").alias("of_"))
    known = logicals.select(F.col("logical_id").alias("known_"), "source")
    held = members.join(known, F.col("logical_id") == F.col("known_"), "left").join(of, F.col("observation_id") == F.col("seen_"), "left")
    what = (
        F.when(F.col("known_").isNull(), "UNKNOWN_RECORD").when(F.col("seen_").isNull(), "UNKNOWN_OBSERVATION")
        .when(~F.col("of_").eqNullSafe(F.col("logical_id")), "OBSERVATION_OF_ANOTHER_RECORD").when(~F.col("source").eqNullSafe(F.lit(source)), "RECORD_OF_ANOTHER_SOURCE")
    )
    bad = held.withColumn("what", what).where("what is not null").select("what", "logical_id", "observation_id")
    twice = members.groupBy("logical_id").agg(F.count("*").alias("n"), F.min("observation_id").alias("observation_id")).where("n > 1 and logical_id is not null")
    return bad.unionByName(twice.select(F.lit("MEMBER_TWICE").alias("what"), "logical_id", "observation_id"))


def write(members: DataFrame, logicals: DataFrame, observations: DataFrame, source: str, path: str, revision: str) -> None:
    """Writes the members of ``revision`` once all are fine; a revision is never written over."""
    first = problems(members, logicals, observations, source).take(1)
    if first:
        raise ValueError(f"{first[0]['what']}: {first[0]['logical_id']}, {first[0]['observation_id']}")
    members.select("logical_id", "observation_id").write.mode("error").parquet(f"{path}/revision={revision}")


def eligible(members: DataFrame) -> DataFrame:
    """The members that may be matched: settled ones that are not barred (``eligible``)."""
    return members.where("state = 'SETTLED' and eligible")
