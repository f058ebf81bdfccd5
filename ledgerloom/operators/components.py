"""Connected components by star steps: every node sends its neighbours to the smallest one near it, until all edges are stars.

A node with many neighbours is no hot key: neighbours are aggregated before they are shuffled, and what nodes of many edges hand on is sent to all tasks."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node of more edges is heavy. There are never more than ``MOST_HEAVY`` of them: beyond that the bound rises with the edges.
HEAVY, MOST_HEAVY = 20_000, 100_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder of the session; one of its own is set only where a local session names none."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="ledgerloom-"))
    return df.checkpoint(eager=True)


def forgotten(*frames: DataFrame) -> None:
    """Deletes the files of frames that were ``cut`` and that nothing reads any more, and lets the driver forget the shuffles that only they needed."""
    for df in frames:
        spark, plan = df.sparkSession, df._jdf.queryExecution().logical()
        held = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if held is not None and held.isDefined():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held.get())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    frames[0].sparkSession.sparkContext._jvm.System.gc()


def _sent(edges: DataFrame, near: DataFrame, least_heavy: int) -> DataFrame:
    """(v, m) for edges (u, v) and near (u, m, n): edges of heavy nodes stay where they are and ``m`` is sent to them, others are joined by a shuffle."""
    heavy = F.broadcast(near.where(F.col("n") > least_heavy).select("u", F.col("m").alias("heavy_m")))
    split = edges.join(heavy, "u", "left")
    hot = split.where("heavy_m is not null").select("v", F.col("heavy_m").alias("m"))
    rest = split.where("heavy_m is null").join(near.where(F.col("n") <= least_heavy), "u")
    return hot.unionByName(rest.select("v", "m"))


def components(edges: DataFrame, most_rounds: int = 100, heavy: int = HEAVY) -> DataFrame:
    """node, component (smallest node) for edges (left_id, right_id), of every node of an edge.

    Rounds grow with the logarithm of the longest path. An edge with a null end says nothing; one from a node to itself makes it a node."""
    ends = cut(edges.where("left_id is not null and right_id is not null").select(F.greatest("left_id", "right_id").alias("u"), F.least("left_id", "right_id").alias("v")).distinct())
    loops, now = ends.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component")), ends.where("u <> v")
    first, n_edges = now, now.count()
    for _ in range(most_rounds if n_edges else 0):
        least_heavy = max(heavy, 2 * n_edges // MOST_HEAVY)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select("u", F.least("u", "v").alias("m"), "n")
        # larger neighbours of a node go to the smallest node near it, itself included
        large = _sent(both.where("v > u"), near, least_heavy).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # smaller neighbours of a node go to the smallest of them, and so does the node
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _sent(large, lowest, least_heavy).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        n_new = new.count()
        if n_new == n_edges and not new.join(now, ["u", "v"], "left_anti").take(1):
            forgotten(new)
            break
        if now is not first:
            forgotten(now)
        now, n_edges = new, n_new
    else:
        if n_edges:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    out = cut(named.unionByName(loops).groupBy("node").agg(F.min("component").alias("component")))
    forgotten(ends, *((now,) if now is not first else ()))
    return out
