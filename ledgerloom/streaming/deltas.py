"""A stream of deltas folded into revisions: each micro-batch makes the next revision, once."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.revisions import merged
from ..sources.store import Store


class Revisions:
    """Revisions as Parquet folders under ``path``; a head file for each names its folder and the batch that made it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path, Store(spark, path)

    def head(self) -> dict:
        """The last revision, the batch that made it and its folder (-1 and none before the first)."""
        names = self.store.names("heads")
        return self.store.read(f"heads/{names[-1]}") if names else {"revision": -1, "batch": -1, "folder": None}

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{self.head()['folder']}")

    def digests(self) -> set[str]:
        """The digests of all revisions that have one (a short text for each revision)."""
        heads = [self.store.read(f"heads/{name}") for name in self.store.names("heads")]
        return {h["digest"] for h in heads if h.get("digest")}

    def publish(self, rows: DataFrame, batch: int, base: int, digest: str | None = None) -> int:
        """Writes the next revision, then its head; refuses a base that is no longer the head.

        Each writer has a folder of its own, and a revision's head file can be made once only, so of two writers one fails."""
        head = self.head()
        if head["revision"] != base:
            raise ValueError(f"revision {base} is stale; the head is {head['revision']}")
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        self._claim(base + 1, {"revision": base + 1, "batch": batch, "folder": folder, "digest": digest})
        return base + 1

    def _claim(self, revision: int, head: dict) -> None:
        self.store.claim(f"heads/{revision:012d}", head)

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """A micro-batch of deltas; one that was published before changes nothing."""
        head = self.head()
        if batch_id <= head["batch"]:
            return
        self.publish(merged(self.read(), batch), batch_id, head["revision"])

    def follow(self, deltas: DataFrame, checkpoint: str) -> StreamingQuery:
        return deltas.writeStream.foreachBatch(self.fold).option("checkpointLocation", os.path.join(checkpoint, "deltas")).trigger(availableNow=True).start()
