"""Operator 10: quality rules with cross-document line frequency.

Two verdicts make one. The base rules look at one text alone (too few words, too much repetition). The
method then looks across texts: lines are normalised (trimmed, ASCII-lowered, runs of digits written as 0,
runs of white space as one space) and hashed, and for each host the distinct documents that hold a line are
counted. Lines above the limit are boilerplate and are removed; a document that loses too much of itself
is depleted and rejected.

What counts as one document: copies repeat every line of each other, which says nothing about boilerplate
(copies are the near-duplicate operator's matter). So distinct texts are counted, each known by one 64-bit hash
(``text_key``). Texts whose normalised lines are the same, in the same order, are copies and count once: a form
whose texts differ in digits only is one text. All others count once each, near copies with other edits included.

Scale: a text goes to Python once, in Arrow batches, and what is shuffled is (host, line hash, text key),
combined before the shuffle by a distinct and then counted. Frequent lines come back by a broadcast only
below a checked number of rows, else by a join that spreads each frequent line over salts.

Defined results: null text counts as empty (no words, fails the base rules); a null host is a host of its
own; repeated rows are one document for a line's count; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Parameters. A line is boilerplate above ``least_documents`` documents of a host and above ``share`` of the host's documents."""

    min_words: int = 50
    max_repeat_percent: int = 50
    least_documents: int = 20
    share: float = 0.002
    depleted_percent: int = 50
    broadcast_rows: int = 200_000
    salts: int = 32


BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeated_words(hashes: np.ndarray, n: int = 3) -> int:
    """Words inside an n-word window that is found twice or more in the text, the first included."""
    windows = textkit.grams(hashes, n)
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    often = np.unique(order[1:][same])
    at = np.searchsorted(often, windows)
    at[at == len(often)] = 0
    hit = often[at] == windows
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[: len(hit)] += hit
    cover[n : n + len(hit)] -= hit
    return int((np.cumsum(cover)[: len(hashes)] > 0).sum())


def _normal(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(_DIGITS).split())


_DIGITS = bytes(48 if 48 <= b <= 57 else b for b in range(256))


def _measure(text: bytes, with_lines: bool) -> tuple:
    data = np.frombuffer(text, np.uint8)
    starts, ends, hashes = textkit.words(data, np.array([0, len(data)], np.int64), lower=False)
    continued = (data & 0xC0) == 0x80
    chars = int((ends - starts).sum() - continued.sum())  # white space is never part of a longer character
    seen: set[bytes] = set()
    again, lines, sizes = 0, [], []
    for line in text.split(b"\n"):
        held = line.split()
        if not held:
            continue
        if line in seen:
            again += 1
        else:
            seen.add(line)
        if with_lines:
            lines.append(_normal(line))
            sizes.append(len(held))
    return (len(starts), chars, int(_SYMBOL[data].sum()), again, repeated_words(hashes)), lines, sizes


def _line_hashes(lines: list[bytes]) -> np.ndarray:
    """64-bit hashes of whole lines, taken over all lines of a text at once."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines)).view(np.int64)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base measures and, per row, its lines (arrays of hashes and of word counts) and the text's key."""
    schema = f"{BASE}, line_hash array<bigint>, line_words array<int>, text_key bigint"
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]
    others = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.buffers(batch.column(batch.schema.get_field_index(text)))
            rows = []
            for i in range(len(offsets) - 1):
                base, lines, sizes = _measure(data[offsets[i] : offsets[i + 1]].tobytes(), True)
                rows.append((*base, _line_hashes(lines), sizes, _line_hashes([b"\n".join(lines)])[0]))
            columns = [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays(keep + columns, names=others + names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)
    return df.select(*others, text).mapInArrow(run, f"{fields}, {schema}" if fields else schema)


def frequent_lines(lines: DataFrame, rules: Rules) -> DataFrame:
    """(host, line_hash) of the lines above the limits. ``lines``: host, line_hash array, text_key, one row per document."""
    hosts = lines.groupBy("host").agg(F.count("*").alias("host_documents"))
    each = lines.select("host", "text_key", F.explode(F.array_distinct("line_hash")).alias("line_hash"))
    # distinct before the count: the same line of copies falls together before and in the shuffle
    pairs = each.select("host", "line_hash", "text_key").distinct()
    counts = pairs.groupBy("host", "line_hash").agg(F.count("*").alias("n"))
    # a host has few rows here; its size is needed only for lines that pass the absolute limit
    above = counts.where(F.col("n") > rules.least_documents)
    hosts = hosts.withColumnRenamed("host", "host_")
    joined = above.join(hosts, F.col("host").eqNullSafe(F.col("host_")))
    return joined.where(F.col("n") > F.col("host_documents") * rules.share).select("host", "line_hash")


def apply(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of ``df``: id, base measures, ``n_boilerplate_words``, ``base_failed``, ``kept``."""
    # the row's own key: ids may be null or repeat
    held = df.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    held = common.written(measured(held.withColumn("row_key", F.monotonically_increasing_id())), "quality")
    often = common.cut(frequent_lines(held.select("host", "line_hash", "text_key"), rules))
    each = held.select("row_key", "host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("line")).select("row_key", "host", "line.line_hash", "line.line_words")
    same = lambda x, y: x.eqNullSafe(y)
    small = often.limit(rules.broadcast_rows + 1).count() <= rules.broadcast_rows
    right = often.select(F.col("host").alias("host_"), F.col("line_hash").alias("line_hash_"))
    on = same(F.col("host"), F.col("host_")) & (F.col("line_hash") == F.col("line_hash_"))
    if small:
        lost = each.join(F.broadcast(right), on)
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1))).alias("salt_")
        lost = each.withColumn("salt", F.pmod("row_key", F.lit(rules.salts)).cast("int")).join(right.select("*", salt), on & (F.col("salt") == F.col("salt_")))
    lost = lost.groupBy("row_key").agg(F.sum("line_words").cast("bigint").alias("n_boilerplate_words"))
    base = held.drop("line_hash", "line_words", "text_key", "host")
    out = base.join(lost, "row_key", "left").withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    depleted = 100 * F.col("n_boilerplate_words") > rules.depleted_percent * F.col("n_words")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate_words"]
    return out.select(*names, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "row_key")


def query(spark, sf_dir: str) -> DataFrame:
    return apply(common.table(spark, sf_dir, "documents")).drop("row_key")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    # ids may be null or repeat: rows with the same id, host and text share a verdict
    keyed = docs.select("doc_id", "source", "text", F.struct("doc_id", "source", F.xxhash64("text").alias("text_hash")).alias("row_id"))
    failed = apply(keyed, id_col="row_id").where("not kept").select(F.col("doc_id").alias("failed_")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("failed_.doc_id")) & F.col("source").eqNullSafe(F.col("failed_.source"))
    return docs.join(common.bounded(common.cut(failed), 1_000_000), same & (F.xxhash64("text") == F.col("failed_.text_hash")), "left_anti")
