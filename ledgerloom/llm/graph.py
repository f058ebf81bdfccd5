"""Connected components of a table of edges, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (two columns of bigint).

    Large-star and small-star steps in turn: every node sends its neighbours to the smallest one near it, until
    all edges are stars. The number of rounds grows with the logarithm of the longest path. Each round is
    one aggregation by node (combined before the shuffle) and one join.
    """
    scratch = common.Scratch(edges.sparkSession, "components")
    a, b = edges.columns
    now = scratch.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of a node go to the smallest node near it
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.keep(small)
        same = common.is_empty(new.join(now, ["u", "v"], "left_anti")) and common.is_empty(now.join(new, ["u", "v"], "left_anti"))
        scratch.drop(now)
        now = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
