"""Operator 3: mixing sources to target weights (DataFrame functions only).

1. *Sizes and targets.* A source's size is its words. Targets share all words by weight; where a target
   would pass ``most_repeats`` times the source's size it stops there and the excess is shared again. The
   fixed point of that resharing is found in one ordered pass over the sources (one row each): sorted by
   size over weight, the first sources are the ones that stop.
2. *Packing.* A source's documents, in a fixed pseudorandom order, are one stream of words, cut into
   blocks of ``block_words``. Documents are laid out with a two-level running sum (hash buckets, then
   inside a bucket), so no task holds a source.
3. *Drawing.* Every slot of every output shard draws its source from the target shares, so a shard's source
   counts are multinomial. Then totals are made exact: slots beyond a source's target are handed, in slot
   order, to the sources that fell short (about the square root of their number moves).
4. *Permutations.* The j-th slot of a source takes block ``permutation(j mod n)`` of epoch ``j div n``. The
   permutation is a swap-or-not shuffle, keyed by source and epoch: exact for any n and computed from j
   alone. A block is taken at most ``most_repeats`` times since a target never needs more epochs.
5. *Join by index.* Drawn blocks are counted and joined to the documents' parts by (source, block).

Sources are known here by a dense number, so a hot source is spread by its blocks. Everything is a
function of the rows and the seed: reruns agree.

Defined results: null text has no words and takes nothing; a null source is a source of its own and the
last by order; repeated rows (also of one id) are laid out one after the other; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROUNDS = 24


@dataclass(frozen=True)
class Mix:
    """Parameters: words in a block, slots in an output shard, how often a document may be taken, the sources' weights in turn."""

    block_words: int = 64
    shard_slots: int = 4096
    most_repeats: int = 3
    weights: tuple[int, ...] = (1, 2, 3)
    seed: int = 20


def permuted(index: Column, n: Column, *key: Column | str) -> Column:
    """Swap-or-not shuffle: a permutation of 0 .. n-1, another for each key."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        swap = F.xxhash64(*key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("bigint"), step)


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size -> also ``nth`` (order of the source), ``weight`` and ``target``. One row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    weights = F.array(*[F.lit(w) for w in mix.weights])
    held = sizes.withColumn("nth", nth).withColumn("weight", F.get(weights, F.pmod("nth", F.lit(len(mix.weights))).cast("int")))
    held = held.withColumn("most", F.col("source_size") * F.lit(mix.most_repeats))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    held = held.withColumn("level", (everything - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward))
    stops = F.col("most") < F.col("level") * F.col("weight")
    held = held.withColumn("final", F.min(F.when(~stops, F.struct(F.col("most") / F.col("weight"), "nth", "level"))).over(Window.partitionBy()))
    share = F.col("final.level") * F.col("weight")
    target = F.least(F.col("most").cast("double"), F.coalesce(share, F.col("most").cast("double")))
    return held.select("source", "source_size", "nth", "weight", target.alias("target"))


def _laid_out(docs: DataFrame, buckets: int, mix: Mix) -> DataFrame:
    """Adds ``begin``: the place of the document's first word in its source's stream."""
    bucket = F.pmod(F.xxhash64(F.lit(mix.seed), "doc_id", "text_key"), F.lit(buckets)).cast("int")
    docs = docs.withColumn("bucket", bucket)
    sums = docs.groupBy("nth", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("nth").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("nth", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("nth", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "text_key", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return docs.withColumn("upto", F.sum("size").over(inside)).join(sums, ["nth", "bucket"]).withColumn("begin", F.col("first") + F.col("upto") - F.col("size"))


def _by_band(slots: DataFrame, plan: DataFrame) -> DataFrame:
    """Each slot's source: the band [low, high) that its number u falls in, met through 1024 cells of [0, 1)."""
    cells = 1024
    cell = F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))).alias("cell")
    bands = plan.select("nth", "low", "high", "slots", cell)
    at = F.floor(F.col("u") * cells).alias("cell")
    return slots.select("slot", "shard", "u", at).join(bands, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).drop("cell", "low", "high")


def _numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, .. inside each ``key`` in (shard, slot) order; counts per run of shards first, then per shard, then inside a shard."""
    counts = rows.groupBy(key, "shard").agg(F.count("*").alias("c")).withColumn("run", F.floor(F.col("shard") / 4096))
    runs = counts.groupBy(key, "run").agg(F.sum("c").alias("s"))
    before = lambda keys, order, c: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(key, "run", before([key], "run", "s").alias("upto"))
    counts = counts.withColumn("inner", before([key, "run"], "shard", "c")).join(runs, [key, "run"]).select(key, "shard", (F.col("upto") + F.col("inner")).alias("first"))
    inside = Window.partitionBy(key, "shard").orderBy("slot")
    return rows.withColumn("r", F.row_number().over(inside)).join(counts, [key, "shard"]).withColumn(name, F.col("first") + F.col("r") - 1).drop("r", "first")


def blocks_taken(plan: DataFrame, total_slots: int, mix: Mix = Mix()) -> DataFrame:
    """nth, block, times. ``plan``: nth, blocks, slots, low, high."""
    spark = plan.sparkSession
    parts = common.clamp(total_slots / 250_000, 1, 1 << 20)
    slots = spark.range(0, total_slots, 1, parts).select(F.col("id").alias("slot"), F.floor(F.col("id") / mix.shard_slots).alias("shard"))
    drawn = _numbered(_by_band(slots.withColumn("u", common.uniform("slot", seed=mix.seed)), plan), "nth", "j")
    drawn = common.cut(drawn.select("nth", "shard", "slot", "j", "slots"))
    fits = drawn.where(F.col("j") < F.col("slots")).select("nth", "j")
    over = drawn.where(F.col("j") >= F.col("slots")).select(F.lit(0).alias("all"), "shard", "slot")
    short = plan.join(drawn.groupBy("nth").agg(F.count("*").alias("got")), "nth", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    short = short.where(F.col("got") < F.col("slots")).withColumn("need", F.col("slots") - F.col("got"))
    upto = F.sum("need").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row for each source
    short = short.withColumn("upto", upto).select("nth", "got", (F.col("upto") - F.col("need")).alias("from"), F.col("upto").alias("to"))
    # the handed-over slots by number: met through cells of 4096 numbers
    cell = 4096
    wanted = short.select("*", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("to") - 1) / cell))).alias("cell"))
    moved = _numbered(over, "all", "k").withColumn("cell", F.floor(F.col("k") / cell)).join(wanted, "cell")
    moved = moved.where((F.col("k") >= F.col("from")) & (F.col("k") < F.col("to"))).select("nth", (F.col("got") + F.col("k") - F.col("from")).alias("j"))
    n = plan.select("nth", "blocks", "slots")
    taken = fits.unionByName(moved).join(F.broadcast(n) if _few(n) else n, "nth").where(F.col("j") < F.col("slots"))
    epoch = F.floor(F.col("j") / F.col("blocks"))
    block = permuted(F.pmod("j", "blocks"), F.col("blocks"), F.lit(mix.seed), F.col("nth"), epoch)
    return taken.select("nth", block.alias("block")).groupBy("nth", "block").agg(F.count("*").alias("times"))


def _few(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


def apply(df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text: str = "text", source: str = "source", row_key: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``df`` (and ``row_key``, made here if no column is named, ``text_key``, ``source``, ``nth``).

    Rows are ordered by id, then by a hash of the text, so only rows that are equal in both depend on ``row_key``."""
    own = F.monotonically_increasing_id() if row_key is None else F.col(row_key)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), common.word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_key"), own.alias("row_key"))
    rows = common.cut(rows)
    sizes = targets(rows.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), mix)
    blocks = F.ceil(F.col("source_size") / mix.block_words).cast("bigint")
    wanted = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint")
    sizes = sizes.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("source_size") > 0, F.least(wanted, F.col("blocks") * mix.most_repeats)).otherwise(F.lit(0)))
    everything = F.sum("slots").over(Window.partitionBy())
    upto = F.sum("slots").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = common.cut(sizes.withColumn("low", (upto - F.col("slots")) / everything).withColumn("high", upto / everything))
    total, n_rows = (int(x) for x in sizes.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.lit(rows.count())).first())
    few = _few(sizes)
    names = sizes.select(F.col("source").alias("source_"), "nth", "source_size", "target")
    known = rows.join(F.broadcast(names) if few else names, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    plan = sizes.where("slots > 0").select("nth", "blocks", "slots", "low", "high")
    times = blocks_taken(plan, total, mix)

    laid = _laid_out(known.where("size > 0").select("nth", "doc_id", "size", "text_key", "row_key"), common.clamp(n_rows / 4_000, 64, 1 << 20), mix)
    b = mix.block_words
    part = F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("begin") + F.col("size") - 1) / b))).alias("block")
    parts = laid.select("nth", "row_key", "begin", "size", part)
    words = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * b) - F.greatest("begin", F.col("block") * b)
    taken = parts.withColumn("words", words).join(times, ["nth", "block"]).groupBy("row_key").agg(F.sum(F.col("words") * F.col("times")).cast("bigint").alias("taken"))
    out = known.join(taken, "row_key", "left")
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "source", "nth", "text_key", "row_key")


def query(spark, sf_dir: str) -> DataFrame:
    return apply(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with each document as often as the mix takes it (whole documents, 0 to 3 times).

    Blocks cut documents; to keep texts whole, words taken over words is rounded to a number of copies. It is
    rounded along the documents of a source in order of size, carrying the remainder on, so a source's words
    stay near its target. Texts without words take no part and go. Rows are known by a key of their own, so ids may be null or repeat."""
    mix = Mix()
    held, key = common.keyed(docs, "mixed")
    plan = common.cut(apply(held, mix, row_key=key).where("size > 0"))
    chunks = plan.groupBy("nth").agg(F.ceil(F.count("*") / 20_000).alias("chunks"))
    plan = plan.join(F.broadcast(chunks) if _few(chunks) else chunks, "nth")
    plan = plan.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_key"), "chunks"))
    along = Window.partitionBy("nth", "chunk").orderBy("size", "doc_id", "text_key", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = plan.withColumn("ratio", F.col("taken") / F.col("size")).withColumn("run", F.sum("ratio").over(along))
    copies = (F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("ratio") + 0.5)).cast("int")
    plan = plan.select(F.col("row_key").alias("mixed_"), F.least(F.lit(mix.most_repeats), copies).alias("times_")).where("times_ > 0")
    joined = held.join(plan, F.col(key) == F.col("mixed_"))
    return joined.withColumn("time_", F.explode(F.sequence(F.lit(1), "times_"))).select(*docs.columns)
