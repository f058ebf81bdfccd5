"""Operator 1: sharding by sampled splitters (DataFrame functions only).

The unit is a group of equal texts. Groups are known by a 64-bit hash of the text (the range key), its CRC-32
and its size, and are counted by a map-side combined aggregation, so a group that holds a third of all rows
is one row afterwards.

1. *Sampled splitters.* Groups are drawn with a chance in proportion to their bytes; quantiles of the drawn
   keys are the boundaries of ranges, many more than shards.
2. *Range partition.* Every group gets its range through a broadcast prefix table of at most
   ``MAX_RANGES`` boundaries; bytes are summed per range. Ranges that hold over twice their share are
   subdivided at further quantiles.
3. *Law ``bytes``.* A group's place in the global byte order is its range's offset plus its own place in the
   range, both exact, so shard borders are exact and not only as good as the sample. Groups over one
   hundredth of a shard (at most 100 for each shard) are placed first, largest first, onto the shard with
   most room; the others fill what room is left. Equal texts thus share a shard. Only a group larger than
   a whole shard is subdivided, by rows in turn.
4. *Slots* are row numbers inside (shard, bucket of rows) plus the buckets' offsets; no task holds a shard.

Defined results: a null text has size 1 and the CRC-32 of no bytes, and is the same as an empty text;
repeated rows each get a slot; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_RANGES = 32_768
_SAMPLE_A_RANGE = 64
_PREFIX_BITS = 12
_GROUP = ["key", "text_crc32", "size"]


def _records(df: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).cast("bigint").alias("text_crc32"), F.xxhash64(body).alias("key"),
    )


def _splitters(groups: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of a sample of keys, drawn by size. Its expected size is ``_SAMPLE_A_RANGE`` for each range."""
    chance = F.col("bytes") * float(_SAMPLE_A_RANGE * ranges) / float(max(1, total))
    drawn = groups.where(common.uniform("key", "text_crc32", seed=11) < chance)
    at = [i / ranges for i in range(1, ranges)]
    if not at:
        return []
    got = drawn.agg(F.percentile_approx("key", at, 100 * ranges).alias("q")).first()["q"]
    return sorted(set(got or []))


def _with_range(df: DataFrame, splitters: list[int]) -> DataFrame:
    """``df`` with ``range``: the number of splitters at or below its key (a broadcast lookup by the key's first bits)."""
    spark = df.sparkSession
    shift = 64 - _PREFIX_BITS
    low = -(1 << (_PREFIX_BITS - 1))
    rows, held = [], {}
    for s in splitters:
        held.setdefault(s >> shift, []).append(s)
    below = 0
    for p in range(low, -low):
        rows.append((p, below, held.get(p, [])))
        below += len(held.get(p, []))
    lookup = spark.createDataFrame(rows, "prefix bigint, below int, inside array<bigint>")
    joined = df.withColumn("prefix", F.shiftright("key", shift)).join(F.broadcast(lookup), "prefix")
    return joined.withColumn("range", F.col("below") + F.size(F.filter("inside", lambda s: s <= F.col("key")))).drop("prefix", "below", "inside")


def _subdivided(groups: DataFrame, splitters: list[int], share: float) -> list[int]:
    """Adds quantiles inside the ranges that came out over twice their share of bytes."""
    sizes = _with_range(groups, splitters).groupBy("range").agg(F.sum("bytes").alias("b"), F.percentile_approx("key", [0.25, 0.5, 0.75], 1000).alias("q"))
    full = sizes.where(F.col("b") > 2 * share).collect()  # at most half as many as there are ranges
    return sorted({*splitters, *(k for r in full for k in r["q"])})


def apply(df: DataFrame, shards: int = 8, range_bytes: int = 64 << 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under law ``bytes``)."""
    rows = _records(df, id_col, text)
    groups = common.cut(rows.groupBy(*_GROUP).agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes")))
    sums = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, count = (int(x) for x in sums)
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    share = total / shards

    # large groups: at most 100 a shard by bytes and as many by rows, so this list is bounded by the shards
    big = (F.col("bytes") > share / 100) | (F.col("n") > max(1.0, count / shards / 100))
    held = groups.where(big).select(*_GROUP, "n", "bytes").collect()
    room = [(0.0, s) for s in range(shards)]
    place, split = [], []
    for g in sorted(held, key=lambda g: (-g["bytes"], g["key"], g["text_crc32"], g["size"])):
        if g["bytes"] > share and g["n"] > 1:
            # subdivided: a part for each shard, its rows dealt out by a hash
            split.append((g["key"], g["text_crc32"], g["size"]))
            room = [(used + g["bytes"] / shards, s) for used, s in room]
            heapq.heapify(room)
            continue
        used, s = heapq.heappop(room)
        place.append((g["key"], g["text_crc32"], g["size"], s))
        heapq.heappush(room, (used + g["bytes"], s))

    spark = df.sparkSession
    kind = "key bigint, text_crc32 bigint, size bigint"
    fixed = spark.createDataFrame([(*p, False) for p in place] + [(*p, 0, True) for p in split], f"{kind}, shard int, dealt boolean")
    small = groups.join(F.broadcast(fixed.select(*_GROUP)), _GROUP, "left_anti")

    # what room is left: the others' bytes are cut at its running sums
    used = dict((s, u) for u, s in room)
    left_bytes = total - sum(g["bytes"] for g in held)
    level = _water_level(list(used.values()), left_bytes)
    cuts, run = [], 0.0
    for s in range(shards):
        run += max(0.0, level - used[s])
        cuts.append(run)
    ranges = common.clamp(left_bytes / range_bytes, min(8 * shards, MAX_RANGES), MAX_RANGES)
    if left_bytes:
        splitters = _splitters(small, left_bytes, ranges)
        splitters = _subdivided(small, splitters, left_bytes / ranges)
        ranged = _with_range(small, splitters)
        offsets = ranged.groupBy("range").agg(F.sum("bytes").alias("b"))
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, MAX_RANGES times two at most
        offsets = offsets.select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("range").orderBy(*_GROUP).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = ranged.withColumn("upto", F.sum("bytes").over(inside)).join(F.broadcast(offsets), "range")
        middle = F.col("offset") + F.col("upto") - F.col("bytes") / 2
        shard = F.least(F.lit(shards - 1), F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= middle)))
        placed = placed.select(*_GROUP, shard.cast("int").alias("shard"))
    else:
        placed = small.select(*_GROUP, F.lit(0).alias("shard"))

    # rows of large groups meet a broadcast of bounded size; those of other groups are too few to be skewed
    known = rows.join(F.broadcast(fixed.withColumnRenamed("shard", "fixed_shard")), _GROUP, "left")
    buckets = common.clamp(count / shards / 50_000, 4, 65_536)
    bucket = F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int")
    # rows of a subdivided group are dealt in turn inside a bucket of rows; buckets begin at different shards
    turn = F.row_number().over(Window.partitionBy(*_GROUP, "bucket").orderBy("doc_id"))
    dealt = known.where("dealt").withColumn("bucket", bucket).withColumn("shard", F.pmod(F.col("bucket") + turn, F.lit(shards)).cast("int"))
    first = known.where("not dealt").select("doc_id", *_GROUP, F.col("fixed_shard").alias("shard"))
    first = first.unionByName(dealt.select("doc_id", *_GROUP, "shard")) if split else first
    rest = known.where(F.col("dealt").isNull()).select("doc_id", *_GROUP).join(placed, _GROUP).select("doc_id", *_GROUP, "shard")
    both = first.unionByName(rest)
    both = common.cut(both.withColumn("bucket", bucket))
    counts = both.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "doc_id")
    out = both.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(counts), ["shard", "bucket"])
    out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    return out.select(*names)


def _water_level(used: list[float], more: float) -> float:
    """The level to which ``more`` fills vessels that already hold ``used``."""
    level, held, n = 0.0, 0.0, 0
    for u in sorted(used):
        if n and held + more <= u * n:
            break
        held, n = held + u, n + 1
    level = (held + more) / max(1, n)
    return level


def query(spark, sf_dir: str) -> DataFrame:
    return apply(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of ``docs`` with its ``shard`` and ``slot``. Rows are known by a key of their own, so ids may be null or repeat."""
    held, key = common.keyed(docs, "sharded")
    placed = apply(held.select(key, "text"), id_col=key).select(F.col("doc_id").alias("placed_"), F.col("shard").alias("shard_"), F.col("slot").alias("slot_"))
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    return held.join(placed, F.col(key) == F.col("placed_")).select(*names, F.col("shard_").alias("shard"), F.col("slot_").alias("slot"))
