"""Identities of records that stay the same over revisions: those that are missing are made, once.

An identity's id is a digest of its key, so every attempt gives a key the same id, on any executor and in any order. An attempt finds its missing keys by one
anti-join, writes them to a folder of its own and publishes that by one file, named after the attempt: a retry finds its file and adds nothing. Two attempts at
one time may both write a key; both have its id, and readers take one row of a key. Then the folders are counted into one (``compacted``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..sources.store import Store


def identity(*key: Column | str) -> Column:
    """The id of a key, whose parts may hold anything."""
    return F.concat(F.lit("logical-"), F.substring(exact.prefixed_digest(*(F.col(k) if isinstance(k, str) else k for k in key)), 1, 32))


def missing(known: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``identity`` of the wanted keys that ``known`` (keys, others) doesn't have; keys with a null part have none."""
    held = wanted.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct()
    return held.join(known.select(*keys), keys, "left_anti").select(*keys, identity(*keys).alias("identity"))


class Identities:
    """The identities under ``path``: a folder for each attempt, named by ``attempts/<attempt>``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.store, self.keys = spark, Store(spark, path), keys
        self.schema = ", ".join(f"{k} string" for k in keys) + ", identity string"

    def read(self) -> DataFrame:
        """keys and identity, one row for each key."""
        folders = [self.store.read(f"attempts/{name}")["folder"] for name in self.store.names("attempts")]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        held = self.spark.read.schema(self.schema).parquet(*(f"{self.store.path}/{folder}" for folder in folders))
        return held.dropDuplicates(self.keys) if len(folders) > 1 else held

    def get_or_create(self, wanted: DataFrame, attempt: str) -> DataFrame:
        """keys and identity of all ``wanted`` keys; those that are missing are published as ``attempt``. Repeated attempts add nothing."""
        if not self.store.exists(f"attempts/{attempt}"):
            folder = f"data/{uuid.uuid4().hex}"
            texts = wanted.select(*(F.col(k).cast("string").alias(k) for k in self.keys))
            missing(self.read(), texts, self.keys).write.parquet(f"{self.store.path}/{folder}")
            try:
                self.store.claim(f"attempts/{attempt}", {"folder": folder})
            except ValueError:  # the same attempt, run twice: the other's folder counts
                pass
        return self.read().join(wanted.select(*(F.col(k).cast("string").alias(k) for k in self.keys)).distinct(), self.keys, "left_semi")
