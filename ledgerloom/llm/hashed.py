"""What the two trained models share: a bounded sample of labelled rows, hashed terms, training by shards, held-out folds.

Training is data-parallel. The sample's rows are dealt to ``shards`` by a hash, each shard runs sequential updates
from the common state, and states are averaged after every round. The sample is bounded by ``most_rows`` and a
state by the number of hashed terms, so what a task or the driver holds does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textkit

Terms = Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]


def held_out(id_: Column) -> Column:
    """Rows that no model learns from: the CRC-32 of the id as text is divisible by 5. A null id is not."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def each_text(batch: pa.RecordBatch, terms: Terms) -> Iterator[np.ndarray]:
    """Sorted distinct hashed terms of each row of the column ``text``."""
    data, offsets = textkit.buffers(batch.column(batch.schema.get_field_index("text")))
    for low, high in textkit.rows_by_size(offsets):
        yield from terms(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])


def sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, shards: int, terms: Terms) -> DataFrame:
    """shard, nth, label, terms (32-bit, binary) of at most ``most_rows`` labelled rows, drawn by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("known_id")).agg(F.min(label).cast("int").alias("label"))
    known = common.cut(known.orderBy(F.xxhash64("known_id"), "known_id").limit(most_rows))
    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("known_id"))  # most_rows rows
    # an id that repeats counts with one of its texts
    chosen = rows.groupBy("known_id").agg(F.min(F.xxhash64(F.coalesce("text", F.lit("")))).alias("chosen"))
    rows = rows.join(F.broadcast(chosen.withColumnRenamed("known_id", "id_")), (F.col("known_id") == F.col("id_")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("chosen"))).select("known_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [t.astype(np.uint32).tobytes() for t in each_text(batch, terms)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary())], names=["id", "label", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, label int, terms binary").dropDuplicates(["id"])
    nth = F.xxhash64("id", F.lit(1))
    return common.written(out.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), nth.alias("nth"), "label", "terms"), "sample")


def _packed(old: np.ndarray, new: np.ndarray) -> bytes:
    """The rows that changed: their number, places and changes."""
    at = np.flatnonzero((new != old).reshape(len(old), -1).any(axis=1)).astype(np.int32)
    return np.int64(len(at)).tobytes() + at.tobytes() + (new[at] - old[at]).astype(np.float32).tobytes()


def _add(sums: list[np.ndarray], raw: bytes) -> None:
    at = 0
    for x in sums:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        rows = np.frombuffer(raw, np.int32, n, at + 8)
        size = n * (x.size // len(x))
        x[rows] += np.frombuffer(raw, np.float32, size, at + 8 + 4 * n).reshape(n, *x.shape[1:])
        at += 8 + 4 * n + 4 * size


def trained(rows: DataFrame, state: list[np.ndarray], learn: Callable, rounds: int) -> list[np.ndarray]:
    """``state`` (32-bit arrays) after ``rounds`` rounds. ``learn(state, [(label, terms)])`` runs a shard's updates and returns its state.

    Shards send the rows of the state that they changed; the driver adds them one shard after the other."""
    if common.is_empty(rows):
        return state
    context = rows.sparkSession.sparkContext
    shards = rows.select("shard").distinct().count()
    for _ in range(rounds):
        now = context.broadcast(state)

        def run(table):
            order = np.argsort(table["nth"].to_numpy())
            labels, held = table["label"].to_numpy(), table["terms"]
            new = learn([x.copy() for x in now.value], [(int(labels[i]), np.frombuffer(held[int(i)].as_py(), np.uint32).astype(np.int64)) for i in order])  # noqa: B023
            return pa.table({"shard": table["shard"].slice(0, 1), "state": pa.array([b"".join(_packed(x, y) for x, y in zip(now.value, new))], pa.binary())})  # noqa: B023

        sums = [np.zeros(x.shape, np.float32) for x in state]
        for r in rows.groupBy("shard").applyInArrow(run, "shard bigint, state binary").sort("shard").toLocalIterator():  # a row for each shard
            _add(sums, r["state"])
        state = [x + y / np.float32(shards) for x, y in zip(state, sums)]
        now.destroy()
    return state


def scored(docs: DataFrame, terms: Terms, score: Callable[[np.ndarray], float], least: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. ``score``: terms to a real number, of which the logistic is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.fromiter((score(t) for t in each_text(batch, terms)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


class Ftrl:
    """Follow-the-regularised-leader updates of hashed weights; term ``dims`` is the constant."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Zero for terms whose evidence stays under l1."""
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, z: np.ndarray, n: np.ndarray, at: np.ndarray, w: np.ndarray, g: float) -> None:
        """One row with gradient ``g`` for each of its terms ``at``, whose weights are ``w``."""
        own = n[at]
        more = own + g * g
        z[at] += g - (np.sqrt(more) - np.sqrt(own)) / self.alpha * w
        n[at] = more


def logistic(x: float) -> float:
    return 1 / (1 + np.exp(-min(35.0, max(-35.0, x))))
