"""Operator 4: exact n-gram Jaccard join by universe partitions.

A text's set is its distinct n-word shingles (hashed to 64 bits). Texts with equal sets are one class, known by a
hash of 64 bits; sets of one name but other sizes or parities (512 bits) are told apart. The join works on classes. It finds every pair of classes with 100 * |A & B| >= percent * |A | B|, as links and
as connected components.

*Size bands.* A set of band k can only match sets of bands k-1 to k+1. Pairs whose smaller set lies in band
k differ in at most H(k) elements (Hamming distance).

*Pigeonhole.* Band k cuts the universe of hashes into segments. A segment counts 1 if it is indexed whole
(equal segments match) and 2 if its one-deletion neighbourhood is indexed too (segments that differ in one
element match). If the segments that count make H(k) + 1, each pair within reach agrees in one of them.

*Cost-based allocation.* Whole segments cost one index row, deletions one more for each element, but small
segments (or empty ones) match by chance. ``Scheme.of`` prices both and takes, for each band, the cheaper
number of deletion segments, plus some spare segments. A deletion segment of one element counts 1 only, since
its match may be empty and unindexed. A set leaves out segments that say little: empty ones, and those with a
row (whole or deletion) that is in more than ``hot`` classes, as long as the segments without such a row count
H(k) + 1. Sets for which they do not, keep theirs. That loses nothing: if either set of a pair has enough segments
left, the pair agrees in one of those; if neither has, both keep all.

*Verification* is exact and does not make all pairs of a group. In each bucket the class that shares most rows
of the index with others is the pivot (the text that others were copied from, where it is there); members are
compared with the ``pivots`` pivots that most of them have and links merge components. The classes near one pivot are then joined by the
elements in which they differ from it (``family_pairs``), which settles all pairs of them. Further pivots are classes
that are still unlinked. After ``rounds`` rounds the members of a bucket that are in different components are
compared with each other, but for pairs that were tested or had a pivot near both. Pairs whose ``parities`` differ in
more bits than linked sets may differ in elements are never compared; the last pairs are first tried by parities of
more bins (``promising``), so long texts travel only where they are nearly linked.

Scale: texts are written once as chunks (see ``chunks``) and never shuffled. For each class one text sends its
signatures, 4 bytes each, and gets back a bit for each that another class has too; only those become rows. Buckets of
the same classes are one bucket with a weight. Shingles of compared texts are made anew in their chunk and
travel once for each comparison, to the pivot's partition; a pivot with many members is spread over salts. Tables
between steps are deleted when used.

Defined results: null or blank text has an empty set, is linked with nothing and is its own component;
rows that repeat a text (or an id) are in one component; null ids take part and are never a component's
name unless it holds no other; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, textkit
from .chunks import SENT, Chunks, answered, fields, read, sent, small_batches
from .graph import components


@dataclass(frozen=True)
class Join:
    """Parameters. ``percent``: the Jaccard threshold in hundredths; ``name_bits``: of a class's name at first."""

    words: int = 5
    percent: int = 80
    rounds: int = 3
    pivots: int = 2
    hot: int = 256
    salt_rows: int = 2_000
    broadcast_rows: int = 1_000_000
    name_bits: int = 64


@dataclass(frozen=True)
class Scheme:
    """How band k is cut: ``deletions`` segments with their one-deletion neighbourhood, then ``whole`` ones."""

    band: int
    need: int
    deletions: int
    whole: int

    @property
    def edges(self) -> np.ndarray:
        m = self.deletions + self.whole
        return np.array([(i << 64) // m for i in range(1, m)], np.uint64)

    @staticmethod
    @lru_cache(4096)
    def of(band: int, percent: int) -> Scheme:
        low, high = band_edges(band, percent)
        both = (high - 1) + (high - 1) * 100 // percent
        need = both * (100 - percent) // (100 + percent) + 1
        n = (low + high) / 2
        best = None
        for deletions in {0, need // 8, need // 4, (need + 1) // 2}:
            for extra in (0, 1, 2, 3, *range(4, 2 * need + 4, max(1, need // 16))):
                whole = max(0, need - 2 * deletions) + extra
                m = deletions + whole
                empty = math.exp(-n / m) if m > 1 else 0.0
                lost = m * empty  # expected number of empty segments
                spare = 2 * deletions + whole - need
                if m > 1 and spare < lost + 4 * math.sqrt(lost):
                    continue
                # rows of the index, and rows of segments of one or two elements, which often match by chance
                few = m * empty * (n / m + (n / m) ** 2 / 2)
                cost = m + deletions * n / m + 0.5 * few
                if best is None or cost < best[0]:
                    best = (cost, deletions, whole)
        if best is None:
            best = (0.0, (need + 1) // 2, 2)
        return Scheme(band, need, best[1], best[2])


@lru_cache(4096)
def _edges(percent: int) -> tuple[int, ...]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return tuple(out)


def band_edges(band: int, percent: int) -> tuple[int, int]:
    """Sizes low <= n < high of a band. The largest partner of a set of band k is in band k + 1."""
    e = _edges(percent)
    return e[band], e[band + 1]


def band_of(n: int, percent: int) -> int:
    return int(np.searchsorted(_edges(percent), n, "right")) - 1


def set_id(shingles: np.ndarray) -> int:
    """64-bit name of a set."""
    with np.errstate(over="ignore"):
        x = textkit.mix(shingles)
        return int(textkit.mix(np.array([x.sum(dtype=np.uint64) * np.uint64(3) + np.bitwise_xor.reduce(x) + np.uint64(len(x))]))[0].astype(np.int64))


@lru_cache(4096)
def _segment_names(band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    scheme = Scheme.of(band, percent)
    m = scheme.deletions + scheme.whole
    return scheme.edges, textkit.mix(np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band * 1_000_003 + 17))


def index_rows(shingles: np.ndarray, percent: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For both schemes of a set: band, signatures, the segment of each, what that counts (0: an empty segment), and
    how much the segments that are not empty count beyond what is needed."""
    n = len(shingles)
    own = band_of(n, percent)
    out = []
    with np.errstate(over="ignore"):
        element = textkit.mix(shingles)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(element, out=total[1:])
        for band in (own, own - 1):
            if band < 0:
                continue
            scheme = Scheme.of(band, percent)
            edges, names = _segment_names(band, percent)
            at = np.concatenate([[0], np.searchsorted(shingles, edges, "left"), [n]])
            sums = total[at[1:]] - total[at[:-1]]
            held = at[1:] > at[:-1]
            counts = np.ones(len(sums), np.int32)
            counts[: scheme.deletions] += np.diff(at)[: scheme.deletions] > 1
            spare = int(counts[held].sum()) - scheme.need
            keep = held if spare >= 0 else np.ones(len(sums), bool)
            signatures, segments = [textkit.mix(sums[keep] + names[keep])], [np.flatnonzero(keep)]
            if scheme.deletions:
                segment = np.repeat(np.arange(scheme.deletions), np.diff(at)[: scheme.deletions])
                less = textkit.mix(sums[segment] - element[: len(segment)] + names[segment])
                signatures.append(less)
                segments.append(segment)
            of = np.concatenate(segments)
            out.append((band, np.concatenate(signatures).view(np.int64), of.astype(np.int32), np.where(held, counts, 0)[of].astype(np.int8), spare))
    return out


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Shingles of every text."""
    for low, high in textkit.rows_by_size(offsets):
        part, base = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, _, hashes = textkit.words(part, base)
        first = textkit.row_slices(starts, base)
        for i in range(high - low):
            yield textkit.shingles(hashes[first[i] : first[i + 1]], words)


#: Columns of a set's parities: bit i of all tells whether it holds an odd number of elements of bin i.
PARITIES = [f"parity{i}" for i in range(8)]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Sets that differ in d elements differ in at most d of these bits."""
    bins = 64 * len(PARITIES)
    counts = np.bincount((shingles % np.uint64(bins)).astype(np.int64), minlength=bins)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _measured(words: int, more: Callable[[np.ndarray], np.ndarray | None] | None = None, name_bits: int = 64) -> Callable[[np.ndarray, np.ndarray], list[pa.Array]]:
    """n, class (null for an empty set) and parities of each text of a batch, and a list that ``more`` makes of the shingles of each."""

    def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        ns, ids, odd, others = [], [], [], []
        for shingles in _shingles(data, offsets, words):
            ns.append(len(shingles))
            ids.append(set_id(shingles) >> 64 - name_bits if len(shingles) else None)
            odd.append(parities(shingles))
            if more:
                others.append(more(shingles))
        bits = np.array(odd, np.int64).reshape(-1, len(PARITIES))
        out = [pa.array(ns, pa.int64()), pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in bits.T)]
        return out + [pa.array(others, pa.list_(pa.int64()))] if more else out

    return run


def _chunk_sets(ends: bytes, data: bytes, places: list[int], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Place and shingles of the texts of a chunk that stand at ``places``."""
    ends, data, wanted = np.frombuffer(ends, np.int64), np.frombuffer(data, np.uint8), sorted(places)
    if 2 * len(wanted) > len(ends):  # most of them: all are read together
        held = set(wanted)
        yield from ((place, shingles) for place, shingles in enumerate(_shingles(data, ends, words)) if place in held)
        return
    for place in wanted:
        own = data[ends[place] : ends[place + 1]]
        yield place, next(_shingles(own, np.array([0, len(own)], np.int64), words))


def index(chunks: Chunks, classes: DataFrame, join: Join, scratch: common.Scratch, bucket_names: int) -> DataFrame:
    """signature, class, band, segment, counts, spare: the rows of the index whose signature two classes have.
    ``classes``: the text that stands for each class (class, part, chunk, place) and the class's size ``n``."""
    words, percent = join.words, join.percent
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits, kept = common.clamp(math.log2(max(1, 2 * total / bucket_names)), 4, 32), 32
    names = ["signature", "class", "band", "segment", "counts", "spare"]
    places = scratch.keep(classes.groupBy("part", "chunk").agg(F.collect_list(F.struct("place", "class")).alias("places")).withColumn("bucket", F.lit(None).cast("bigint")).withColumn("met", F.lit(None).cast("binary")))

    def sets(ends: bytes, data: bytes, told: list[dict]) -> Iterator[tuple[int, list]]:
        own = {p["place"]: p["class"] for t in told if t["bucket"] is None for p in t["places"]}
        for place, shingles in _chunk_sets(ends, data, list(own), words):
            yield own[place], index_rows(shingles, percent)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk, ends, data, told in fields(batches, "part", "chunk", "ends", "data", "told"):
            held = [np.unique(np.concatenate([signatures for _, signatures, _, _, _ in rows])) for _, rows in sets(ends, data, told)]
            if held:
                yield sent(part, chunk, np.concatenate(held).view(np.uint64), bits, kept)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int16(), pa.int32(), pa.int8(), pa.int32()]
        for ends, data, told in fields(batches, "ends", "data", "told"):
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for name, rows in sets(ends, data, told):
                own = [np.concatenate([r[1] for r in rows])]
                own += [np.full(len(own[0]), name)]
                own += [np.concatenate([np.full(len(r[1]), r[0], np.int16) for r in rows]), np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])]
                own += [np.concatenate([np.full(len(r[1]), r[4], np.int32) for r in rows])]
                once = np.sort(np.unique(own[0], return_index=True)[1])
                for column, x in zip(columns, own):
                    column.append(x[once])
            if columns[0]:
                whole = [np.concatenate(x) for x in columns]
                met = read(whole[0].view(np.uint64), bits, kept, [t for t in told if t["bucket"] is not None])
                yield pa.RecordBatch.from_arrays([pa.array(x[met], k) for x, k in zip(whole, kinds)], names=names)

    answers = scratch.keep(answered(chunks.told(places, "inner").mapInArrow(first, SENT), kept).withColumn("places", F.lit(None).cast("array<struct<place:int,class:bigint>>")))
    scratch.swept()
    out = scratch.keep(chunks.told(places.unionByName(answers), "inner").mapInArrow(second, "signature bigint, class bigint, band smallint, segment int, counts tinyint, spare int"))
    scratch.drop(places, answers)
    return out


_BATCH_BYTES = 8 << 20
_DEALT = pa.schema([("pivot", pa.int64()), ("salt", pa.int64()), ("bins", pa.int64()), ("is_member", pa.int32()), ("member", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _compared(pairs: DataFrame, chunks: Chunks, classes: DataFrame, join: Join, scratch: common.Scratch, payload: Callable, compare: Callable, schema: str) -> DataFrame:
    """``compare`` (member, pivot, payload of both) of all ``pairs`` (member, pivot, bins). Payloads are made from the shingles in the
    ``chunks`` and go to the pivot's partition; a pivot of many members has several."""
    words = join.words
    salts = pairs.groupBy("pivot").agg(F.count("*").alias("c")).where(F.col("c") > join.salt_rows)
    salts = salts.select("pivot", F.ceil(F.col("c") / join.salt_rows).alias("salts"))
    pairs = pairs.join(salts, "pivot", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("member"), "salts"), F.lit(0)))
    pairs = scratch.keep(pairs.select("member", "pivot", "salt", "bins"))
    asked = pairs.select(F.col("member").alias("class"), "pivot", "salt", "bins", F.lit(1).alias("is_member"))
    asked = asked.unionByName(pairs.select(F.col("pivot").alias("class"), "pivot", "salt", "bins", F.lit(0).alias("is_member")).distinct())
    asked = asked.join(classes.select("class", "part", "chunk", "place"), "class")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ends, data, told in fields(batches, "ends", "data", "told"):
            by: dict[int, list[dict]] = {}
            for t in told:
                by.setdefault(t["place"], []).append(t)
            rows, size = [], 0
            for place, shingles in _chunk_sets(ends, data, list(by), words):
                held = {bins: payload(shingles, bins) for bins in {t["bins"] for t in by[place]}}
                for t in by[place]:
                    rows.append((t["pivot"], t["salt"], t["bins"], t["is_member"], t["class"], held[t["bins"]]))
                    size += len(rows[-1][-1])
                    if size > _BATCH_BYTES:
                        yield _batch(rows, _DEALT)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, _DEALT)

    dealt = chunks.told(asked, "inner").mapInArrow(made, "pivot bigint, salt bigint, bins bigint, is_member int, member bigint, payload binary")
    dealt = dealt.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "bins", "is_member")
    out = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, b""
        for batch in batches:
            found = []
            for pivot, bins, is_member, member, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pivot", "bins", "is_member", "member", "payload"))):
                if not is_member:
                    now, own = (pivot, bins), raw
                    continue
                assert now == (pivot, bins)
                if (row := compare(member, pivot, raw, own)) is not None:
                    found.append(row)
            if found:
                yield _batch(found, out)

    done = scratch.keep(dealt.mapInArrow(run, schema))
    scratch.drop(pairs)
    return done


_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def verified(pairs: DataFrame, chunks: Chunks, classes: DataFrame, join: Join, scratch: common.Scratch, differ: bool = False) -> DataFrame:
    """member, pivot, n, pivot_n (sizes), linked, near, differ of all pairs (member, pivot). ``near``: they share half of
    their union at least; then ``differ``, if asked for, holds the elements of just one of the two."""
    percent = join.percent

    def compare(member: int, pivot: int, raw: bytes, other: bytes) -> tuple:
        got, own = np.frombuffer(raw, np.uint64), np.frombuffer(other, np.uint64)
        both = len(np.intersect1d(own, got, assume_unique=True))
        union = len(own) + len(got) - both
        near = 2 * both >= union
        apart = np.setxor1d(own, got, assume_unique=True).view(np.int64) if near and differ else None
        return member, pivot, len(got), len(own), 100 * both >= percent * union, near, apart

    schema = "member bigint, pivot bigint, n bigint, pivot_n bigint, linked boolean, near boolean, differ array<bigint>"
    return _compared(pairs.withColumn("bins", F.lit(0).cast("bigint")), chunks, classes, join, scratch, lambda shingles, _: shingles.tobytes(), compare, schema)


def _odd(shingles: np.ndarray, bins: int) -> bytes:
    """The set's size, then a bit for each bin: whether it holds an odd number of the set's elements."""
    bits = np.bincount((shingles % np.uint64(bins)).astype(np.int64), minlength=bins) & 1
    return len(shingles).to_bytes(8, "little") + np.packbits(bits.astype(np.uint8)).tobytes()


def promising(pairs: DataFrame, chunks: Chunks, classes: DataFrame, join: Join, scratch: common.Scratch) -> DataFrame:
    """The ``pairs`` (member, pivot) that may be linked by the parities of bins, four for each element of the larger set: a sixteenth of
    the shingles' bytes. Sets that differ in d elements differ in at most d bits, so no link is lost."""
    sizes = classes.select(F.col("class").alias("class_"), F.col("n").alias("n_"))
    sized = pairs.select("member", "pivot")
    for end in ("member", "pivot"):
        sized = sized.join(sizes, F.col(end) == F.col("class_")).withColumnRenamed("n_", f"n_{end}").drop("class_")
    bins = F.pow(F.lit(2.0), F.ceil(F.log2(4 * F.greatest("n_member", "n_pivot")))).cast("bigint")
    least, most = 100 - join.percent, 100 + join.percent

    def compare(member: int, pivot: int, raw: bytes, own: bytes) -> tuple | None:
        bits = int(np.unpackbits(np.frombuffer(raw, np.uint8, offset=8) ^ np.frombuffer(own, np.uint8, offset=8)).sum())
        both = int.from_bytes(raw[:8], "little") + int.from_bytes(own[:8], "little")
        return (member, pivot) if most * bits <= least * both else None

    return _compared(sized.select("member", "pivot", F.greatest(bins, F.lit(64)).alias("bins")), chunks, classes, join, scratch, _odd, compare, "member bigint, pivot bigint")


def families(tested: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """All rows near the pivots that gained members by ``tested`` (``fresh``: by it, not by an earlier round), and the rows seen so far with them."""
    fresh = tested.where("near").withColumn("fresh", F.lit(True))
    old = fresh.withColumn("fresh", F.lit(False))
    if seen is None:
        return fresh, old
    gained = fresh.select(F.col("pivot").alias("pivot_")).distinct()
    return fresh.unionByName(seen.join(gained, F.col("pivot") == F.col("pivot_"), "left_semi")), seen.unionByName(old)


def family_pairs(tested: DataFrame, state: DataFrame, join: Join, scratch: common.Scratch) -> DataFrame:
    """member, pivot: the pairs of classes near one pivot that may be linked and are in different components. ``tested``
    holds all classes near each pivot; of those that met it in earlier rounds (not ``fresh``) pairs are settled.

    Let D be the elements in which a class differs from the pivot, and X = (100 + percent) * |D| - (100 - percent) * n.
    Two classes are linked just if 2 * (100 + percent) * |D & D'| >= X + X', since A and B differ in what D and D' do.
    A class that isn't linked with the pivot has X > P = (100 - percent) * (the pivot's size), any other X >= -P, so
    each knows how many elements of D it must share with another, and its rarest elements beyond that many less
    one hold one of those (the prefix filter), rarity being counted among the pivot's classes. Elements that one class
    alone has come first and are met by nobody: copies of a pivot with edits of their own make no pair.
    """
    near = tested.where("near").withColumn("far", ~F.col("linked"))
    least, most = 100 - join.percent, 100 + join.percent
    x, p = most * F.size("differ") - least * F.col("n"), least * F.col("pivot_n")
    share = lambda v: F.greatest(F.lit(1), F.ceil(v / (2 * most)))
    near = near.withColumn("tight", F.size("differ") - share(x + p + 1) + 1).withColumn("loose", F.when(F.col("far"), F.size("differ") - share(x - p) + 1))
    open_ = near.where("far").select(F.col("pivot").alias("pivot_")).distinct()
    near = near.join(open_, F.col("pivot") == F.col("pivot_"), "left_semi")
    rows = near.select("pivot", "member", "n", "far", "fresh", "tight", "loose", F.size("differ").alias("d"), F.explode("differ").alias("element"))
    rows = scratch.keep(rows)
    counts = rows.groupBy("pivot", "element").agg(F.count("*").alias("c")).where("c > 1")
    counts = counts.select(F.col("pivot").alias("pivot_"), F.col("element").alias("element_"), "c")
    met = rows.join(counts, (F.col("pivot") == F.col("pivot_")) & (F.col("element") == F.col("element_"))).drop("pivot_", "element_")
    own = Window.partitionBy("pivot", "member")
    met = met.withColumn("rank", F.row_number().over(own.orderBy("c", "element")) + F.col("d") - F.count("*").over(own))
    met = met.where(F.col("rank") <= F.greatest("tight", F.coalesce("loose", F.lit(0))))
    met = met.join(state.select(F.col("class").alias("member"), "component"), "member")
    met = scratch.keep(met.select("pivot", "element", "member", "n", "component", "far", "fresh", (F.col("rank") <= F.col("tight")).alias("tight")))
    other = met.select(*(F.col(c).alias(f"other_{c}") for c in met.columns)).where("other_far")
    same = (F.col("pivot") == F.col("other_pivot")) & (F.col("element") == F.col("other_element")) & (F.col("component") != F.col("other_component")) & F.col("tight")
    same &= F.when(F.col("far"), F.col("other_tight") & (F.col("member") < F.col("other_member"))).otherwise(F.lit(True))
    same &= F.col("fresh") | F.col("other_fresh")
    same &= 100 * F.least("n", "other_n") >= join.percent * F.greatest("n", "other_n")
    out = scratch.keep(met.join(other, same).select("member", F.col("other_member").alias("pivot")).distinct())
    scratch.drop(rows, met)
    return out


def worth(a: Callable[[str], Column], b: Callable[[str], Column], join: Join) -> Column:
    """Whether a pair may be linked, would merge components and is not settled, by the pivots that its classes have met so far."""
    out = (a("component") != b("component")) & (100 * F.least(a("n"), b("n")) >= join.percent * F.greatest(a("n"), b("n")))
    bits = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in PARITIES), F.lit(0))
    out &= (100 + join.percent) * bits <= (100 - join.percent) * (a("n") + b("n"))
    return out & ~F.arrays_overlap(a("near"), b("near")) & ~F.array_contains(a("apart"), b("class")) & ~F.array_contains(b("apart"), a("class"))


def merged(state: DataFrame, found: DataFrame) -> DataFrame:
    """``state`` after the links ``found`` (member, pivot)."""
    if common.is_empty(found):
        return state
    a, b = state.select(F.col("class").alias("member"), F.col("component").alias("a")), state.select(F.col("class").alias("pivot"), F.col("component").alias("b"))
    new = components(found.join(a, "member").join(b, "pivot").select("a", "b").where("a <> b").distinct())
    new = new.select(F.col("node").alias("component"), F.col("component").alias("new_"))
    return state.join(new, "component", "left").withColumn("component", F.coalesce("new_", "component")).drop("new_")


def buckets(met: DataFrame, join: Join, scratch: common.Scratch) -> DataFrame:
    """signature, weight, class: the classes that share rows of the index ``met``. Of rows that the same classes have one
    stays, and ``weight`` tells their number."""
    sizes = met.groupBy("signature").agg(F.count("*").alias("classes")).where("classes > 1").withColumnRenamed("signature", "signature_")
    # segments in many classes are left out where the set's other segments suffice
    marked = scratch.keep(met.join(sizes, F.col("signature") == F.col("signature_")).withColumn("hot", F.col("classes") > join.hot).drop("signature_", "classes"))
    lost = marked.where("hot").groupBy("class", "band", "segment").agg(F.first("counts").alias("counts"), F.first("spare").alias("spare"))
    lost = lost.groupBy("class", "band").agg(F.sum("counts").alias("lost"), F.min("spare").alias("spare_"))
    lost = lost.where("spare_ >= lost").select(F.col("class").alias("class_"), F.col("band").alias("band_"))
    enough = marked.where("hot").join(lost, (F.col("class") == F.col("class_")) & (F.col("band") == F.col("band_")), "left_anti")
    rows = scratch.keep(marked.where("not hot").select("signature", "class").unionByName(enough.select("signature", "class")))
    scratch.drop(marked)
    return weighed(rows, scratch)


def weighed(rows: DataFrame, scratch: common.Scratch) -> DataFrame:
    """signature, weight, class: ``rows`` (signature, class; kept in ``scratch``) of the signatures that two classes have, one signature of those that the same classes have."""
    same = [F.bit_xor(F.xxhash64(F.lit(k), "class")).alias(f"of{k}") for k in (1, 2)]
    prints = rows.groupBy("signature").agg(F.count("*").alias("classes"), *same).where("classes > 1")
    prints = prints.groupBy("classes", "of1", "of2").agg(F.min("signature").alias("signature_"), F.count("*").alias("weight")).select("signature_", "weight")
    out = scratch.keep(rows.join(prints, F.col("signature") == F.col("signature_")).select("signature", "weight", "class"))
    scratch.drop(rows)
    return out


def pigeonholes(chunks: Chunks, classes: DataFrame, join: Join, scratch: common.Scratch, bucket_names: int = 1 << 20) -> DataFrame:
    """signature, weight, class: buckets of which any two linked classes share one."""
    met = index(chunks, classes, join, scratch, bucket_names)
    shared = buckets(met, join, scratch)
    scratch.drop(met)
    return shared


def links(chunks: Chunks, classes: DataFrame, join: Join, scratch: common.Scratch, shared: DataFrame) -> DataFrame | None:
    """class, component of the classes that share a bucket with another. ``classes``: class, n, part, chunk, place and parities;
    ``shared``: their buckets (signature, weight, class)."""
    scratch.swept()
    if common.is_empty(shared):
        return None
    shares = shared.groupBy("signature").agg((F.count("*") * F.first("weight")).alias("c")).withColumnRenamed("signature", "signature_")
    shares = shared.join(shares, F.col("signature") == F.col("signature_")).groupBy("class").agg(F.sum("c").alias("shares"))
    # near: the class and the pivots that it is near; apart: pivots that it was compared with and is not near
    state = classes.select("class", "n", *PARITIES).join(shares, "class").withColumns({"component": F.col("class"), "linked": F.lit(False), "used": F.lit(False), "near": F.array("class")})
    state = scratch.keep(state.withColumn("apart", F.array().cast("array<bigint>")))
    seen = None
    for _ in range(join.rounds):
        open_ = shared.join(state, "class")
        first = F.min(F.struct("used", "linked", -F.col("shares"), F.xxhash64("class"), *state.columns))
        heads = open_.groupBy("signature").agg(F.min("component").alias("x"), F.max("component").alias("y"), first.alias("head")).where("x <> y").select(F.col("signature").alias("signature_"), "head")
        pairs = open_.join(heads, (F.col("signature") == F.col("signature_")) & worth(F.col, lambda c: F.col("head")[c], join))
        votes = scratch.keep(pairs.groupBy(F.col("class").alias("member"), F.col("head.class").alias("pivot")).agg(F.sum("weight").alias("votes")))
        if common.is_empty(votes):  # what others of the buckets may hold is left to the last comparison
            break
        # a member meets the pivots of most members, so that a group's members have pivots in common
        known_by = votes.groupBy("pivot").agg(F.count("*").alias("members"))
        place = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("members"), F.desc("votes"), "pivot"))
        pairs = votes.join(known_by, "pivot").withColumn("place_", place).where(F.col("place_") <= join.pivots).select("member", "pivot")
        tested = verified(pairs, chunks, classes, join, scratch, differ=True)
        own = tested.groupBy(F.col("member").alias("class")).agg(F.max("linked").alias("linked_"), *(F.collect_list(F.when(ok, F.col("pivot"))).alias(c) for c, ok in (("near_", F.col("near")), ("apart_", ~F.col("near")))))
        used = tested.select(F.col("pivot").alias("class"), F.lit(True).alias("used_")).distinct()
        told = state.join(own, "class", "left").join(used, "class", "left")
        told = told.withColumn("linked", F.col("linked") | F.coalesce("linked_", F.lit(False))).withColumn("used", F.col("used") | F.coalesce("used_", F.lit(False)))
        for c in ("near", "apart"):
            told = told.withColumn(c, F.concat(c, F.coalesce(f"{c}_", F.array().cast("array<bigint>"))))
        state = scratch.keep(merged(scratch.keep(told.drop("linked_", "used_", "near_", "apart_")), tested.where("linked").select("member", "pivot")))
        near, seen = families(tested, seen)
        family = family_pairs(near, state, join, scratch)
        if not common.is_empty(family):
            state = scratch.keep(merged(state, verified(family, chunks, classes, join, scratch).where("linked").select("member", "pivot")))
        seen = scratch.keep(seen)
        scratch.rest(shared, state, seen)
        scratch.swept()
    # buckets of one component, or whose classes are all near one pivot, are settled
    open_ = shared.join(state, "class")
    sizes = open_.groupBy("signature").agg(F.count("*").alias("c"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(F.col("signature").alias("signature_"), "c")
    near = open_.select("signature", F.explode("near").alias("pivot")).groupBy("signature", "pivot").agg(F.count("*").alias("c")).groupBy("signature").agg(F.max("c").alias("most"))
    left = sizes.join(near, F.col("signature") == F.col("signature_")).where("most < c").select("signature_")
    open_ = scratch.keep(open_.join(left, F.col("signature") == F.col("signature_"), "left_semi"))
    other = open_.select(*(F.col(c).alias(f"other_{c}") for c in open_.columns))
    same = (F.col("signature") == F.col("other_signature")) & (F.col("class") < F.col("other_class"))
    pairs = open_.join(other, same & worth(F.col, lambda c: F.col(f"other_{c}"), join))
    pairs = scratch.keep(pairs.select(F.col("class").alias("member"), F.col("other_class").alias("pivot")).distinct())
    scratch.drop(open_)
    if not common.is_empty(pairs):
        pairs = promising(pairs, chunks, classes, join, scratch)
        state = merged(state, verified(pairs, chunks, classes, join, scratch).where("linked").select("member", "pivot"))
    return scratch.keep(state.select("class", "component"))


def grouped(df: DataFrame, join: Join, chunk_bytes: int = 4 << 20, bucketed: Callable = pigeonholes, measured: str = "", measure: Callable | None = None) -> DataFrame:
    """doc_id, text_key, n, component (null for an empty set), component_id for each row of (doc_id, text). ``bucketed`` (chunks, classes, join,
    scratch) makes the buckets; for it, ``measure`` may make the columns ``measured`` of a set from its shingles, which ``classes`` then has too."""
    scratch = common.Scratch(df.sparkSession, "ngram_join")
    more = [x.split(":")[0].strip() for x in measured.split(",") if x]
    columns = ", ".join([*(f"{c}: bigint" for c in ("n", "class", *PARITIES)), *([measured] if measured else [])])
    chunks = Chunks(df.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), chunk_bytes, columns, _measured(join.words, measure, join.name_bits))
    rows = chunks.table.select("part", "chunk", F.posexplode("rows").alias("place", "row"))
    known = scratch.keep(rows.select("part", "chunk", "place", "row.*"))
    at, sure = F.min(F.struct("part", "chunk", "place", *PARITIES)).alias("at"), F.xxhash64("n", *PARITIES)
    while True:
        classes = known.where("class is not null").groupBy("class").agg(at, F.max("n").alias("n"), F.count("*").alias("rows"), F.min("doc_id").alias("first_id"), F.min(sure).alias("low"), F.max(sure).alias("high"), *(F.first(c).alias(c) for c in more))
        classes = scratch.keep(classes.select("class", "n", "rows", "first_id", "at.*", "low", "high", *more))
        mixed = classes.where("low <> high").select("class", F.lit(True).alias("mixed"))
        if common.is_empty(mixed):
            break
        # different sets of one name get names of their own
        told_apart = known.join(mixed, "class", "left").withColumn("class", F.when(F.col("mixed"), F.xxhash64("class", sure)).otherwise(F.col("class"))).drop("mixed")
        known = scratch.keep(told_apart.select(*known.columns))
    steps = common.Scratch(df.sparkSession, "links")
    with small_batches(df.sparkSession):
        state = links(chunks, classes, join, steps, bucketed(chunks, classes, join, steps))
    chunks.drop()
    if state is None:
        state = classes.select("class", F.col("class").alias("component")).limit(0)
    total, count = classes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    joined = classes.select("class", "rows", "first_id").join(state, "class", "left").withColumn("component", F.coalesce("component", "class"))
    joined = scratch.keep(joined)
    names = common.heavy(joined.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("c")), "c", count).drop("c")
    named = common.spread_join(joined.select("class", "component", "rows"), scratch.keep(names), "component")
    named = scratch.keep(common.heavy(named, "rows", total).drop("rows"))
    empty = known.where("class is null").select("doc_id", "text_key", "n", F.lit(None).cast("bigint").alias("component"), F.col("doc_id").alias("component_id"))
    out = common.spread_join(known.where("class is not null").select("doc_id", "text_key", "n", "class"), named, "class").select(*empty.columns)
    steps.rest()
    scratch.rest(known, named)
    scratch.swept()
    return out.unionByName(empty)


def apply(df: DataFrame, join: Join = Join(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the component) for each row of ``df``."""
    out = grouped(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), join)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return apply(common.table(spark, sf_dir, "documents"), Join(words=3, percent=90))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (a null id comes last), of several such the
    one with the smallest hash of its text. Texts without words all stay. Rows are known by id and text, so ids may be null or repeat."""
    scratch = common.Scratch(spark, "near_duplicates")
    found = scratch.keep(grouped(docs.select("doc_id", "text"), Join()).where("component is not null").groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("rows")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    groups = found.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("c"))
    groups = scratch.keep(common.heavy(groups, "c", found.count()).drop("c"))
    verdicts = common.spread_join(found, groups, "component").withColumn("kept", order.eqNullSafe(F.col("first")))
    # what goes, and what is one of several rows of the same id and text
    other = scratch.keep(verdicts.where("not kept or rows > 1").select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "kept"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("key_"))
    lone = docs.join(common.bounded(other.drop("kept"), 1_000_000), same, "left_anti")
    again = docs.join(common.bounded(other.where("kept").drop("kept"), 1_000_000), same, "left_semi")
    first = again.groupBy("doc_id", F.xxhash64("text").alias("key_")).agg(F.min(F.struct(*docs.columns)).alias("first")).select("first.*")
    return lone.unionByName(first)


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR x IN regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')] AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+2], ' ') FOR i IN range(1, len(ws) - 1)]) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
r AS (SELECT doc_id, g FROM e WHERE g IN (SELECT g FROM e GROUP BY g HAVING count(*) > 1)),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y
)
SELECT n.doc_id, n.n AS n_shingles, min(reach.y) AS component_id FROM n JOIN reach ON reach.x = n.doc_id GROUP BY 1, 2
"""
