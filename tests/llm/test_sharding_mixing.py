import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def check_shards(df, shards=8, tolerance=0.05):
    rows = sharding.apply(df, shards).collect()
    texts = df.select("doc_id", "text").collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in texts)
    slots, held = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(held.values()) / shards
    if tolerance:
        assert max(held.values()) <= (1 + tolerance) * mean and len(held) == shards
    return rows


def test_shards_of_table(documents):
    rows = check_shards(documents, tolerance=0.03)
    by_text = defaultdict(set)
    for r in rows:
        by_text[(r["text_crc32"], r["size"])].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values()), "equal texts share a shard"
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.apply(documents.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_ranges_and_hot_group(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 9)).otherwise(F.concat_ws(" ", F.lit("text"), "id", "id", F.col("id") * 7)).alias("text"))
    check_shards(df, 8, 0.02)
    check_shards(df, 2, 0.02)
    check_shards(df.where("id % 3 = 0"), 4, 0.1)


def test_odd_shards(spark, odd, none):
    check_shards(odd, tolerance=None)
    assert sharding.apply(none).count() == 0
    out = sharding.stage(spark, odd, "")
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    got = Counter((r["shard"], r["slot"]) for r in out.collect())
    assert max(got.values()) == 1


def water(sizes, weights=(1, 2, 3), most=3):
    """Reshares the excess until no source is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def check_mix(df, near=0.05, mix=mixing.Mix()):
    rows = mixing.apply(df, mix).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in df.select("doc_id", "text").collect())
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want, taken = water(sizes, mix.weights), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= near * t + mix.block_words, s
    return rows


def test_mix_of_table(spark, documents):
    rows = check_mix(documents)
    again = check_mix(documents.repartition(5))
    key = lambda rows: sorted((r["doc_id"], r["taken"]) for r in rows)
    assert key(rows) == key(again), "reruns agree"
    check_mix(documents.where("source in ('src0', 'src3') or doc_id % 50 = 7"))


def test_mix_stops_at_three_times(spark):
    rows = [(i, " ".join(["w"] * 300), "big") for i in range(60)] + [(100 + i, " ".join(["v"] * 100), f"s{i}") for i in range(3)]
    check_mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), mix=mixing.Mix(block_words=16))


def test_odd_mix(spark, odd, none):
    check_mix(odd, near=0.2)
    assert mixing.apply(none).count() == 0
    assert mixing.stage(spark, odd, "").columns == odd.columns
    assert mixing.stage(spark, none, "").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 256])
def test_permutations(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(3)).alias("x"), mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(4)).alias("y")).collect()
    assert sorted(r["x"] for r in got) == list(range(n)) == sorted(r["y"] for r in got)
    assert n < 10 or [r["x"] for r in got] != [r["y"] for r in got]


def test_stage_words_near_target(spark, documents):
    out = mixing.stage(spark, documents, "")
    sizes = {r["doc_id"]: (r["source"], r["size"], r["target"]) for r in mixing.apply(documents).collect()}
    taken, times = Counter(), Counter()
    for r in out.select("doc_id").collect():
        taken[sizes[r[0]][0]] += sizes[r[0]][1]
        times[r[0]] += 1
    assert max(times.values()) <= 3
    largest = Counter()
    for s, n, t in sizes.values():
        largest[s] = max(largest[s], n)
    for s, _, t in sizes.values():
        assert abs(taken[s] - t) <= largest[s] + 0.05 * t
