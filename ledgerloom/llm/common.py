"""Helpers that every operator of this subpackage shares: reading tables, cutting lineage, small maths."""

from __future__ import annotations

import gc
import math
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_MASK32 = 0xFFFFFFFF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master (tests) gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(where)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that a lost executor repeats no more than a task."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again (for wide intermediate tables)."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables in the shared folder, each deleted when it has been used."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
        self.held: dict[int, tuple[DataFrame, str]] = {}
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again: lineage is cut, and a lost executor repeats no more than a task."""
        self.count += 1
        path = os.path.join(self.folder, str(self.count))
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Deletes the files of ``frames`` (those that were not kept here are passed over)."""
        for df in frames:
            if df is not None and id(df) in self.held:
                deleted(self.spark, self.held.pop(id(df))[1])

    def rest(self, *but: DataFrame | None) -> None:
        """Deletes all files but those of ``but``."""
        spared = {id(df) for df in but}
        self.drop(*(df for k, (df, _) in list(self.held.items()) if k not in spared))

    def swept(self) -> None:
        """Lets the driver forget the plans of deleted tables, whose shuffle files executors then delete too."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def heavy(counts: DataFrame, count: str, total: int, most: int = 500) -> DataFrame:
    """``counts`` with ``heavy``: whether the key holds more than one in ``most`` of ``total`` rows (so fewer than ``most`` do)."""
    return counts.withColumn("heavy", F.col(count) > F.lit(max(1, total / most)))


def spread_join(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``named`` (one row for each ``key``, and ``heavy``): heavy keys, of bounded number, are broadcast, so none of them is one task's."""
    big = F.broadcast(named.where("heavy").drop("heavy"))
    rest = rows.join(big.select(key), key, "left_anti").join(named.where(~F.col("heavy")).drop("heavy"), key)
    return rows.join(big, key).unionByName(rest)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) for each row."""
    return (F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def word_count(text: Column) -> Column:
    """Number of words, counted as word starts without building an array of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def keyed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written with a key for each row, and the key's column. Ids may be null or repeat; a key that is written stays the same when tasks are repeated."""
    key = "row_key"
    while key in df.columns:
        key += "_"
    return written(df.withColumn(key, F.monotonically_increasing_id()), name), key


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def clamp(x: float, low: int, high: int) -> int:
    return int(max(low, min(high, math.ceil(x))))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (they are counted up to there); else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dropped(spark: SparkSession, name: str) -> None:
    """Removes a table of the catalogue that ``shared_dir`` holds, and its files."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    deleted(spark, os.path.join(shared_dir(spark), name))


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``shared_dir`` holds."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
