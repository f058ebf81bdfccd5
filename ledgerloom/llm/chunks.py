"""Texts that stay where they are: a table of chunks, and hashes sent to meet those of other chunks.

Texts are written once, as chunks of about ``chunk_bytes``, in a table bucketed by *part*, the task that wrote them.
A chunk sends each bucket of names (64-bit hashes) one row with its distinct names, sorted and packed, so a name
that a third of all texts hold is sent once by each chunk. It gets one bit for each name back: whether the name
is *met*, that is, found twice. What is told to chunks (answers, places to read) is joined on the bucketing column, so
texts are never shuffled.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit

#: What a row counts beside its bytes when chunks are filled.
_ROW_BYTES = 64
#: Bytes after which a batch goes to a Python worker.
_BATCH_BYTES = 8 << 20
Measure = Callable[[np.ndarray, np.ndarray], list[pa.Array]]


@contextmanager
def small_batches(spark) -> Iterator[None]:
    """What runs inside sends Python workers batches of few chunks. Spark's own bound of 64 MB counts several times: in a buffer outside
    the heap that is doubled as it grows, in the worker, and for each task of an executor, whose heap is full on large inputs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(_BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def released() -> None:
    """Gives memory that is free back to the system: a worker waits for the next stage, and what it keeps is its executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Chunks:
    """The table: part, chunk, rows (array of structs, one for each text), ends and data (binary)."""

    def __init__(self, texts: DataFrame, chunk_bytes: int, measured: str = "", measure: Measure | None = None):
        """``texts``: columns to carry, then the text. ``measure`` makes the columns ``measured`` of the structs from bytes and offsets of a batch."""
        spark = texts.sparkSession
        self.spark, self.name = spark, f"chunks_{uuid.uuid4().hex}"
        self.parts = common.clamp(texts.rdd.getNumPartitions(), 1, 50_000)
        labels = _labels(spark, self.parts)
        carried = texts.columns[:-1]
        fields = [f"`{f.name}`: {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]]
        names = carried + [x.split(":")[0].strip() for x in measured.split(",") if x]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = TaskContext.get().partitionId()
            part, chunk = labels[own % len(labels)], own // len(labels) << 32
            rows, pieces, sizes, held = [], [], [], 0

            def flush() -> pa.RecordBatch:
                structs = pa.concat_arrays(rows)
                lists = pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)
                ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
                columns = [pa.array([part], pa.int64()), pa.array([chunk], pa.int64()), lists, pa.array([ends.tobytes()], pa.binary()), pa.array([b"".join(pieces)], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "rows", "ends", "data"])

            for batch in batches:
                data, offsets = textkit.buffers(batch.column(batch.num_columns - 1))
                columns = [_plain(batch.column(i)) for i in range(batch.num_columns - 1)] + (measure(data, offsets) if measure else [])
                structs = pa.StructArray.from_arrays(columns, names=names)
                weight = offsets + _ROW_BYTES * np.arange(len(offsets))
                low = 0
                while low < len(structs):
                    high = int(np.searchsorted(weight, weight[low] + chunk_bytes - held, "right")) - 1
                    if high <= low and not rows:
                        high = low + 1  # a text longer than a chunk is one of its own
                    if high > low:
                        rows.append(structs.slice(low, high - low))
                        pieces.append(data[offsets[low] : offsets[high]].tobytes())
                        sizes.append(np.diff(offsets[low : high + 1]))
                        held += int(weight[high] - weight[low])
                        low = high
                    if low < len(structs):
                        yield flush()
                        rows, pieces, sizes, held, chunk = [], [], [], 0, chunk + 1
            if rows:
                yield flush()
            released()

        out = texts.mapInArrow(run, f"part bigint, chunk bigint, rows array<struct<{', '.join([*fields, measured] if measured else fields)}>>, ends binary, data binary")
        path = os.path.join(common.shared_dir(spark), self.name)
        write = out.write.option("path", path).option("compression", "zstd").option("parquet.block.size", str(4 * chunk_bytes)).bucketBy(self.parts, "part")
        with small_batches(spark):
            write.format("parquet").saveAsTable(self.name)
        self.table = spark.table(self.name)

    def told(self, what: DataFrame, how: str = "left") -> DataFrame:
        """The table with ``told``: the rows of ``what`` (part, chunk, others) for each chunk, dealt out as the chunks are, which stay where they are.

        Rows are gathered for each chunk, not for its part, so no value grows with a part. They are dealt out by part alone, which the grouping
        by part and chunk accepts; the chunk is no key of the join, which would move the texts, but a condition on what the part holds."""
        others = [c for c in what.columns if c != "part"]
        dealt = what.withColumnsRenamed({"part": "part_"}).repartition(self.parts, "part_")
        dealt = dealt.groupBy("part_", F.col("chunk").alias("chunk_")).agg(F.collect_list(F.struct(*others)).alias("told"))
        own = (F.col("part") == F.col("part_")) & (F.col("chunk") - F.col("chunk_") == 0)
        out = self.table.join(dealt.hint("shuffle_hash"), own, how).drop("part_", "chunk_")
        return out if how == "inner" else out.withColumn("told", F.coalesce("told", F.array().cast(out.schema["told"].dataType)))

    def drop(self) -> None:
        common.dropped(self.spark, self.name)


def _plain(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _labels(spark, parts: int) -> list[int]:
    """For each bucket of ``parts`` a number that bucketing puts there, so that no bucket gets two parts. (A row for each comes to the driver.)"""
    many = spark.range(0, parts * (20 + 2 * parts.bit_length()), 1, 1).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("bucket"))
    found = {r["bucket"]: r["label"] for r in many.groupBy("bucket").agg(F.min("id").alias("label")).collect()}
    return [found.get(b, b) for b in range(parts)]


def fields(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named values of each row."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)
    released()


def _keys(names: np.ndarray, bits: int, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct leading ``bits + kept`` bits (64 at most), which of them the chunk holds twice, and each name's place among them."""
    distinct, place, counts = np.unique(names >> np.uint64(max(0, 64 - bits - kept)), return_inverse=True, return_counts=True)
    return distinct, counts > 1, place


def _cuts(distinct: np.ndarray, bits: int, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (the first ``bits`` bits) that are held, and where each begins."""
    bucket = (distinct >> np.uint64(min(64 - bits, kept))).astype(np.int64)
    held, first = np.unique(bucket, return_index=True)
    return held, np.append(first, len(distinct))


def sent(part: int, chunk: int, names: np.ndarray, bits: int, kept: int) -> pa.RecordBatch:
    """A row for each bucket: the names' remaining ``kept`` bits, sorted, and a bit for those held twice."""
    distinct, twice, _ = _keys(names, bits, kept)
    held, cuts = _cuts(distinct, bits, kept)
    size = kept // 8
    raw = distinct.view(np.uint8).reshape(-1, 8)[:, :size]
    blobs = [raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    flags = [np.packbits(twice[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    m = len(held)
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(np.full(m, part), pa.int64()), pa.array(np.full(m, chunk), pa.int64()), pa.array(blobs, pa.binary()), pa.array(flags, pa.binary())], names=["bucket", "part", "chunk", "names", "twice"])


SENT = "bucket bigint, part bigint, chunk bigint, names binary, twice binary"


def answered(rows: DataFrame, kept: int) -> DataFrame:
    """part, chunk, bucket, met: for each sent row a bit for each name, set if the name is found twice."""
    size = kept // 8

    def meet(table):
        blobs, flags = table["names"].to_pylist(), table["twice"].to_pylist()
        counts = np.array([len(b) // size for b in blobs])
        raw = np.zeros((counts.sum(), 8), np.uint8)
        raw[:, :size] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, size)
        names = raw.view(np.uint64).ravel()
        twice = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=c) for f, c in zip(flags, counts.tolist())]).astype(bool)
        order = np.argsort(names, kind="stable")
        line = names[order]
        new = np.append(True, line[1:] != line[:-1])
        group = np.cumsum(new) - 1
        size_of = np.bincount(group)
        any_twice = np.zeros(len(size_of), bool)
        any_twice[group[twice[order]]] = True
        met = np.zeros(len(names), bool)
        met[order] = (size_of[group] > 1) | any_twice[group]
        at = np.concatenate([[0], np.cumsum(counts)])
        bits = [np.packbits(met[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
        return pa.table([table["part"], table["chunk"], table["bucket"], pa.array(bits, pa.binary())], names=["part", "chunk", "bucket", "met"])

    return rows.groupBy("bucket").applyInArrow(meet, "part bigint, chunk bigint, bucket bigint, met binary")


def read(names: np.ndarray, bits: int, kept: int, answers: list[dict]) -> np.ndarray:
    """Which of ``names`` are met."""
    distinct, _, place = _keys(names, bits, kept)
    held, cuts = _cuts(distinct, bits, kept)
    by = {a["bucket"]: a["met"] for a in answers}
    met = [np.unpackbits(np.frombuffer(by[k], np.uint8), count=int(b - a)) for k, a, b in zip(held.tolist(), cuts[:-1], cuts[1:])]
    return (np.concatenate(met) if met else np.zeros(0, np.uint8)).astype(bool)[place.ravel()]
