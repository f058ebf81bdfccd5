import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common
from ledgerloom.llm import ngram_join as nj
from ledgerloom.llm.chunks import Chunks
from ledgerloom.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + min(n, len(words))]) for i in range(len(words) - min(n, len(words)) + 1)} if words else set()


def brute(rows, n, percent):
    """Every pair of rows."""
    held = [(i, shingles(t, n)) for i, t in rows]
    root = list(range(len(held)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for k, (_, s) in enumerate(held):
        for g in s:
            by[g].add(k)
    for k, (_, a) in enumerate(held):
        for j in {j for g in a for j in by[g] if j < k}:
            b = held[j][1]
            if 100 * len(a & b) >= percent * len(a | b):
                root[find(k)] = find(j)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(held):
        if i is not None:
            ids[find(k)].append(i)
    name = lambda k: held[k][0] if not held[k][1] else min(ids[find(k)], default=None)
    return sorted(((i, len(s), name(k)) for k, (i, s) in enumerate(held)), key=str)


def got(df, join):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.apply(df, join).collect()), key=str)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_table(documents, n, percent):
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    assert got(documents, nj.Join(words=n, percent=percent)) == brute(rows, n, percent)


def _edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("percent, hot, rounds, salt_rows", [(80, 256, 2, 2000), (80, 3, 0, 5), (90, 4, 1, 10), (60, 2, 3, 3)])
def test_groups_of_near_copies(spark, percent, hot, rounds, salt_rows):
    rng = random.Random(percent + hot)
    rows = []
    for g in range(25):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([2, 3, 5, 8, 12, 20, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            rows.append((len(rows), _edited(rng, base, rng.randrange(1 + len(base) // 8))))
    line = " ".join(f"line{k}" for k in range(12))
    rows += [(1000 + i, line + " " + " ".join(f"u{i}x{k}" for k in range(rng.randrange(30)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    join = nj.Join(words=2, percent=percent, hot=hot, rounds=rounds, salt_rows=salt_rows, broadcast_rows=50 if hot == 2 else 10**6)
    assert got(df, join) == brute(rows, 2, percent)


def test_odd(spark, odd, none):
    rows = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    assert got(odd, nj.Join()) == brute(rows, 5, 80)
    assert nj.apply(none).count() == 0
    out = nj.stage(spark, odd, "")
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i in [1, 2, 3, 4, 5, 6, 8, 9, None, 11, 12])


def test_stage_keeps_one_of_each(spark, documents):
    found = nj.apply(documents, nj.Join()).collect()
    kept = sorted(r["doc_id"] for r in nj.stage(spark, documents, "").collect())
    assert kept == sorted({r["component_id"] for r in found})


def test_pigeonhole_by_scheme():
    """Sets within reach agree in a signature that one of them keeps, for all sizes and thresholds."""
    rng = np.random.default_rng(3)
    for percent in (60, 80, 90, 95):
        for n in [*range(1, 60), 100, 333, 1000]:
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            lost = rng.integers(0, n - -(-percent * n // 100) + 1)
            b = a[np.sort(rng.permutation(len(a))[lost:])]
            more = rng.integers(0, max(1, (100 * len(b) - percent * n) // percent + 1))
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
            i = len(np.intersect1d(a, b))
            if not len(b) or 100 * i < percent * (len(a) + len(b) - i):
                continue
            x, y = ({(band, s) for band, sig, *_ in nj.index_rows(v, percent) for s in sig.tolist()} for v in (a, b))
            assert x & y, (percent, n, len(b))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(edges, "a bigint, b bigint").where(F.col("a") != F.col("b"))
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_pivot_that_is_met_in_two_rounds(spark):
    """A and B are linked and near P, which isn't linked with them: A since one round, B since a later one, C (linked with nothing) since the first too."""
    word = lambda x: " ".join(f"w{k}" if k % 8 else f"{x}{k}" for k in range(100))
    texts = {"p": " ".join(f"w{k}" for k in range(100)), "a": word("x"), "b": word("x") + " end", "c": word("y")}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id bigint, text string")
    join = nj.Join(words=1, percent=90)
    scratch = common.Scratch(spark, "test")
    chunks = Chunks(df, 1 << 20, ", ".join(f"{c}: bigint" for c in ("n", "class", *nj.PARITIES)), nj._measured(1))
    known = scratch.keep(chunks.table.select("part", "chunk", F.posexplode("rows").alias("place", "row")).select("part", "chunk", "place", "row.*"))
    p, a, b, c = (r["class"] for r in known.orderBy("doc_id").collect())
    state = known.select("class", F.col("class").alias("component"))
    pairs = lambda *members: nj.verified(spark.createDataFrame([(m, p) for m in members], "member bigint, pivot bigint"), chunks, known, join, scratch, differ=True)
    near, seen = nj.families(pairs(a, c), None)
    assert {tuple(sorted((r["member"], r["pivot"]))) for r in nj.family_pairs(near, state, join, scratch).collect()} <= {tuple(sorted((a, c)))}
    near, seen = nj.families(pairs(b), seen)
    found = {tuple(sorted((r["member"], r["pivot"]))) for r in nj.family_pairs(near, state, join, scratch).collect()}
    assert tuple(sorted((a, b))) in found and tuple(sorted((a, c))) not in found
    assert seen.count() == 3 and not any(r["linked"] for r in seen.collect())


def test_promising_pairs_keep_every_link():
    rng = np.random.default_rng(8)
    for n in (1, 5, 60, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 9 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]))
        bins = 1 << max(6, int(np.ceil(np.log2(4 * n))))
        x, y = (np.frombuffer(nj._odd(v, bins), np.uint8, offset=8) for v in (a, b))
        apart = len(np.setxor1d(a, b))
        assert 0.75 * apart <= np.unpackbits(x ^ y).sum() <= apart
