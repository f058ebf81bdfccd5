"""Decisions by the records that they touched, in any revision: an inverted index beside the history.

A posting says that a decision touched a record, from which revision on. Batches of history append postings, in order of the record and in files of ranges of it;
a batch's head holds the lowest and the highest record, so a search opens the batches whose range it meets, and of those the row groups.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store

_ENDS = ("left_id", "right_id", "record_id")


def postings(history: DataFrame) -> DataFrame:
    """record_id, decision_id, since (revision) of ``history`` (decision_id, revision, and some of left_id, right_id, record_id)."""
    ends = F.explode(F.array_distinct(F.array_compact(F.array(*(F.col(c) for c in _ENDS if c in history.columns)))))
    return history.select(ends.alias("record_id"), "decision_id", "revision").groupBy("record_id", "decision_id").agg(F.min("revision").alias("since"))


def touching(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """decision_id of the decisions with a posting for a record of ``wanted`` (id)."""
    return held.join(wanted.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_semi").select("decision_id").distinct()


def listed(history: DataFrame, found: DataFrame) -> DataFrame:
    """The last revision of the decisions of ``found`` (decision_id), and ``created``, the first one's number."""
    others = [c for c in history.columns if c != "decision_id"]
    own = history.join(found, "decision_id", "left_semi")
    return own.groupBy("decision_id").agg(F.max_by(F.struct(*others), "revision").alias("last"), F.min("revision").alias("created")).select("decision_id", "last.*", "created")


class Index:
    """The postings under ``path``: a folder for each batch, named with its range by ``batches/<batch>``."""

    def __init__(self, spark: SparkSession, path: str, files: int = 16):
        self.spark, self.store, self.files = spark, Store(spark, path), files

    def append(self, history: DataFrame, batch: str) -> None:
        """Adds the postings of a batch of history; a batch that was added before adds nothing."""
        if self.store.exists(f"batches/{batch}"):
            return
        folder = f"data/{uuid.uuid4().hex}"
        postings(history).repartitionByRange(self.files, "record_id").sortWithinPartitions("record_id").write.parquet(f"{self.store.path}/{folder}")
        low, high = self._folder(folder).agg(F.min("record_id"), F.max("record_id")).first()
        self.store.claim(f"batches/{batch}", {"folder": folder, "low": low, "high": high})

    def _folder(self, folder: str) -> DataFrame:
        return self.spark.read.schema("record_id string, decision_id string, since int").parquet(f"{self.store.path}/{folder}")

    def postings_between(self, low: str | None, high: str | None) -> DataFrame:
        """Postings of records from ``low`` to ``high``, of the batches that hold any."""
        heads = [self.store.read(f"batches/{name}") for name in self.store.names("batches")] if low is not None else []
        met = [h["folder"] for h in heads if h["low"] is not None and h["low"] <= high and low <= h["high"]]
        if not met:
            return self.spark.createDataFrame([], "record_id string, decision_id string, since int")
        return reduce(DataFrame.unionByName, [self._folder(f) for f in met]).where(F.col("record_id").between(low, high))

    def search(self, wanted: DataFrame, few: int = 1000) -> DataFrame:
        """decision_id of all decisions that touched a record of ``wanted`` (id). Of up to ``few`` records all are pushed to the files, beyond that their range."""
        ids = [r[0] for r in wanted.select("id").distinct().limit(few + 1).collect()]
        if len(ids) <= few:
            low, high = (min(ids), max(ids)) if ids else (None, None)
            held = self.postings_between(low, high).where(F.col("record_id").isin(ids) if ids else F.lit(False))
            return held.select("decision_id").distinct()
        low, high = wanted.agg(F.min("id"), F.max("id")).first()
        return touching(self.postings_between(low, high), wanted)
