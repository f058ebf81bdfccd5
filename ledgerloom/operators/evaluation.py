"""Strategies beside the engine's own, and the table that compares them with known pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut
from .policy import Matching


def greedy(scored: DataFrame, policy: Matching = Matching(), most_rounds: int = 1000) -> DataFrame:
    """left_id, right_id, score: acceptable edges by score, then ids, each taken if both of its records are free.

    An edge that is the first of both its ends is taken whatever comes before it elsewhere, so all such edges go in one round."""
    rank = F.struct((-F.col("score")).alias("s"), "left_id", "right_id")
    free = cut(scored.where((F.col("score") >= policy.threshold) & F.col("covered") & ~F.col("contradicted")).select("left_id", "right_id", "score", rank.alias("rank")))
    taken = []
    for _ in range(most_rounds):
        first = lambda end: free.groupBy(end).agg(F.min("rank").alias(f"first_{end}"))
        both = free.join(first("left_id"), "left_id").join(first("right_id"), "right_id")
        now = cut(both.where("rank = first_left_id and rank = first_right_id").select("left_id", "right_id", "score"))
        if not now.take(1):
            break
        taken.append(now)
        free = cut(free.join(now.select("left_id"), "left_id", "left_anti").join(now.select("right_id"), "right_id", "left_anti"))
    else:
        raise RuntimeError(f"edges were left after {most_rounds} rounds")
    out = free.select("left_id", "right_id", "score")
    for t in taken:
        out = out.unionByName(t)
    return out


def quality(name: str, found: DataFrame, truth: DataFrame, reached: DataFrame, weighted_truth: DataFrame, n_records: int) -> DataFrame:
    """One row for a strategy: counts and percents to four places, null over nothing.

    ``reached``: candidate edges of the strategy; ``weighted_truth``: the pairs that no reference gives."""
    keys = ["left_id", "right_id"]
    n = lambda df, as_: df.agg(F.count("*").alias(as_))
    row = n(found.join(truth, keys, "left_semi"), "n_correct").crossJoin(n(found, "n_found")).crossJoin(n(truth, "n_truth"))
    row = row.crossJoin(n(reached.join(weighted_truth, keys, "left_semi"), "n_reached")).crossJoin(n(weighted_truth, "n_weighted"))  # rows of counts, one each
    part = lambda a, b: F.round(F.lit(100.0) * F.try_divide(a, b), 4)
    c = F.col
    return row.select(
        F.lit(name).alias("strategy"), "n_correct", "n_found", "n_truth", part(c("n_correct"), c("n_found")).alias("precision"), part(c("n_correct"), c("n_truth")).alias("recall"),
        part(c("n_reached"), c("n_weighted")).alias("candidate_recall"), (c("n_found") - c("n_correct")).alias("false_matches"), part(F.lit(n_records) - 2 * c("n_found"), F.lit(n_records)).alias("review_rate"),
    )
