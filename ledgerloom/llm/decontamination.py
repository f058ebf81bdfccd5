"""Operator 5: benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. *Seeds.* An item's seeds are its distinct runs of ``seed_words`` words (lower-cased, punctuation dropped).
2. *Rarity* is measured over all documents: the number of documents that hold a seed. Seeds that no document holds
   have no rank. Of the others the rarer ``rare_share`` of each item are rare, at least ``least_seeds`` of them and all
   that tie with the last. So an item that was copied into many documents has rare seeds too: they are compared with
   the item's other seeds only.
3. *Join.* A pass over the documents finds the seeds; each gives a diagonal in the alignment of item and document.
   Windows around neighbouring diagonals, wide enough for all gaps that ``least_score`` allows, are aligned if one of
   their seeds is rare. Those of common seeds only (the half of an item that others hold too) are aligned unless the
   item's words that the window holds can't reach ``least_score``, which loses nothing.
4. *Alignment.* Smith-Waterman over words (match +2, mismatch -1, gap -1), many windows at a time. The
   score is the best one found over the best possible (2 for each word of the item). From ``least_score``
   on the document counts as contaminated.

Scale: items go to the tasks in blocks of at most ``block_bytes`` of text, so what is broadcast is bounded, and
every document meets every block. Nothing is shuffled but counts of seeds and found pairs. Long windows are
cut into overlapping ones, so memory follows the batch.

Defined results: null or short texts (fewer words than a seed) meet nothing, as document and as item; repeated rows are each
found; a null item id is kept; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit


@dataclass(frozen=True)
class Leaks:
    """Parameters."""

    seed_words: int = 3
    rare_share: float = 0.5
    least_seeds: int = 8
    least_score: float = 0.5
    block_bytes: int = 16 << 20
    batch_cells: int = 200_000


def _words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return textkit.words(data, offsets, space=textkit.NOT_WORD)


@dataclass
class Block:
    """Items of one block: word hashes, and for each found seed where it stands in which item and whether it is rare there."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    rare: np.ndarray

    @staticmethod
    def of(rows: list[tuple], leaks: Leaks, found: tuple[np.ndarray, np.ndarray] | None = None) -> Block:
        """``rows``: id, text. ``found``: the seeds that documents hold (sorted) and by how many; only those are held then.

        Of an item's found seeds the rarer ``rare_share`` are rare, ``least_seeds`` at least, with all that tie with the last."""
        held, seeds, items, places = [], [], [], []
        for k, (_, text) in enumerate(rows):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            held.append(_words(raw, np.array([0, len(raw)]))[2])
            grams = textkit.grams(held[-1], leaks.seed_words).view(np.int64)
            seeds.append(grams)
            items.append(np.full(len(grams), k))
            places.append(np.arange(len(grams)))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        seeds, items, places = cat(seeds), cat(items), cat(places)
        rare = np.zeros(len(seeds), bool)
        if found is not None:
            at, number = _found(found[0], seeds) if len(found[0]) else (np.zeros(0, np.int64),) * 2
            seeds, items, places, counts = seeds[at], items[at], places[at], found[1][number]
            # each seed of an item once, the item's rarest first
            once = np.unique(np.stack([items, counts, seeds]), axis=1) if len(at) else np.zeros((3, 0), np.int64)
            held_items, first, own = np.unique(once[0], return_index=True, return_counts=True)
            place = np.minimum(own, np.maximum(leaks.least_seeds, np.ceil(own * leaks.rare_share).astype(np.int64)))
            last = np.zeros(len(rows), np.int64)
            last[held_items] = once[1][first + place - 1]
            rare = counts <= last[items]
        order = np.argsort(seeds, kind="stable")
        distinct, first = np.unique(seeds[order], return_index=True)
        return Block([r[0] for r in rows], held, distinct, np.append(first, len(seeds)), items[order], places[order], rare[order])


def _documents(batch: pa.RecordBatch, seed_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, word hashes and seeds of the texts of a batch."""
    data, offsets = textkit.buffers(batch.column(batch.schema.get_field_index("text")))
    for low, high in textkit.rows_by_size(offsets):
        base = offsets[low : high + 1] - offsets[low]
        starts, _, hashes = _words(data[offsets[low] : offsets[high]], base)
        first = textkit.row_slices(starts, base)
        for i in range(high - low):
            own = hashes[first[i] : first[i + 1]]
            if len(own) >= seed_words:
                yield low + i, own, textkit.grams(own, seed_words).view(np.int64)


def _found(seeds: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``grams`` that hold a seed, and the seed's number."""
    at = np.searchsorted(seeds, grams)
    at[at == len(seeds)] = 0
    hit = np.flatnonzero(seeds[at] == grams)
    return hit, at[hit]


def seed_counts(docs: DataFrame, block: Block, leaks: Leaks) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of ``block`` that documents hold, sorted, and by how many. (16 bytes for each come to the driver.)"""
    seeds = docs.sparkSession.sparkContext.broadcast(block.seeds)
    n = leaks.seed_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(seeds.value), np.int64)
        for batch in batches:
            for _, _, grams in _documents(batch, n):
                counts[np.unique(_found(seeds.value, grams)[1])] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seeds.value[some]), pa.array(counts[some])], names=["seed", "n"])

    out = docs.select("text").mapInArrow(run, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    found, counts = out["seed"].to_numpy(), out["n"].to_numpy()
    order = np.argsort(found)
    return found[order], counts[order]


def align(windows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of each row of ``windows`` with the same row of ``items`` (0 pads both): best score, and the window's word where it ends.

    One step for each word of the items; gaps along the window are a running maximum."""
    gaps = np.arange(windows.shape[1], dtype=np.int32)
    above = np.zeros(windows.shape, np.int32)
    best, end = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int64)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        gain = np.where((windows == word) & (word != 0), np.int32(2), np.int32(-1))
        now = above - 1
        gain[:, 1:] += above[:, :-1]
        np.maximum(now, gain, out=now)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + gaps, axis=1) - gaps
        at = now.argmax(axis=1)
        top = now[np.arange(len(now)), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        above = now
    return best, end


def _windows(hits: np.ndarray, block: Block, number: np.ndarray, words: int, leaks: Leaks) -> Iterator[tuple[int, int, int, bool]]:
    """item, begin, end of the parts of a document to align, and whether they hold a rare seed."""
    counts = block.first[number + 1] - block.first[number]
    entry = np.repeat(block.first[number] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    item, diagonal = block.item[entry], np.repeat(hits, counts) - block.place[entry]
    order = np.lexsort((diagonal, item))
    item, diagonal, rare = item[order], diagonal[order], block.rare[entry][order]
    for k in np.unique(item).tolist():
        mine = item == k
        own, first = np.unique(diagonal[mine], return_index=True)
        marks = np.logical_or.reduceat(rare[mine], first)
        n = len(block.words[k])
        pad = int(2 * n * (1 - leaks.least_score)) + 2  # more gaps cost too much
        new = np.flatnonzero(np.append(True, np.diff(own) > n + 2 * pad))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(own)]):
            low, high = max(0, int(own[a]) - pad), min(words, int(own[b - 1]) + n + pad)
            size, step, sure = 4 * n + 4 * pad, 2 * n, bool(marks[a:b].any())
            while high - low > size:
                yield k, low, low + size, sure
                low += step
            yield k, low, high, sure


def pairs(docs: DataFrame, block: Block, leaks: Leaks) -> DataFrame:
    """doc_id, item (number in the block), score, end_word of the contaminated documents."""
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in batches:
            found: dict[tuple[int, int], tuple[float, int]] = {}
            waiting: list[tuple[int, int, int, np.ndarray]] = []
            cells = 0

            def flush() -> None:
                waiting.sort(key=lambda x: len(x[3]))
                while waiting:
                    part, size = [], 0
                    while waiting and size + len(waiting[-1][3]) <= max(leaks.batch_cells, len(waiting[-1][3])):
                        part.append(waiting.pop())
                        size += len(part[0][3])
                    windows = np.zeros((len(part), len(part[0][3])), np.uint64)
                    items = np.zeros((len(part), max(len(block.words[k]) for _, k, _, _ in part)), np.uint64)
                    for r, (_, k, _, w) in enumerate(part):
                        windows[r, : len(w)] = w
                        items[r, : len(block.words[k])] = block.words[k]
                    best, end = align(windows, items)
                    for (row, k, low, _), score, at in zip(part, best.tolist(), end.tolist()):
                        score /= 2 * len(block.words[k])
                        if score >= leaks.least_score and score > found.get((row, k), (0,))[0]:
                            found[row, k] = (score, low + at + 1)

            for row, words, grams in _documents(batch, leaks.seed_words):
                hits, number = _found(block.seeds, grams)
                if not len(hits):
                    continue
                for k, low, high, sure in _windows(hits, block, number, len(words), leaks):
                    # each word of the item gains 2 at most, and only if the window holds it
                    if not sure and np.isin(block.words[k], words[low:high]).sum() < leaks.least_score * len(block.words[k]):
                        continue
                    waiting.append((row, k, low, words[low:high]))
                    cells += high - low
                    if cells > 20 * leaks.batch_cells:
                        flush()
                        cells = 0
            flush()
            keys = sorted(found)
            columns = [batch.column(0).take(pa.array([r for r, _ in keys], pa.int64())), pa.array([k for _, k in keys], pa.int64()), pa.array([found[x][0] for x in keys], pa.float64()), pa.array([found[x][1] for x in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item", "score", "end_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, item bigint, score double, end_word bigint")


def apply(df: DataFrame, benchmark: DataFrame, leaks: Leaks = Leaks(), id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, end_word (word of the document at which the alignment ends): a row for each contaminated pair."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    blocks = common.ceil_div(int(total) + 1, leaks.block_bytes)
    kind = items.schema["item_id"].dataType.simpleString()
    out = []
    for k in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == k)
        rows = [tuple(r) for r in mine.collect()]  # about block_bytes of text
        block = Block.of(rows, leaks)
        if not len(block.seeds):
            continue
        found = seed_counts(docs, block, leaks)
        if not len(found[0]):
            continue
        block = Block.of(rows, leaks, found)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item bigint, item_id {kind}")
        out.append(common.cut(pairs(docs, block, leaks).join(F.broadcast(names), "item").select("doc_id", "item_id", "score", "end_word")))
    if not out:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind}, score double, end_word bigint")
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_


def query(spark, sf_dir: str) -> DataFrame:
    return apply(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Rows are known by id and text, so ids may be null or repeat."""
    named = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("row_id"), "text")
    found = apply(named, common.table(spark, sf_dir, "benchmark"), id_col="row_id").select(F.col("doc_id").alias("leaked_")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("leaked_.doc_id")) & (F.xxhash64("text") == F.col("leaked_.text_hash"))
    return docs.join(common.bounded(common.cut(found), 1_000_000), same, "left_anti")
