import random

import numpy as np
import pytest

from ledgerloom.llm import decontamination as d


def slow_align(a, b):
    """Cell by cell."""
    best = 0
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = random.Random(1)
    for _ in range(30):
        pairs = [([rng.randrange(1, 6) for _ in range(rng.randrange(1, 30))], [rng.randrange(1, 6) for _ in range(rng.randrange(1, 15))]) for _ in range(8)]
        w, t = (np.zeros((8, max(len(p[k]) for p in pairs)), np.uint64) for k in (0, 1))
        for r, p in enumerate(pairs):
            w[r, : len(p[0])], t[r, : len(p[1])] = p
        assert d.align(w, t)[0].tolist() == [slow_align(b, a) for a, b in pairs]


@pytest.mark.parametrize("leaks", [d.Leaks(), d.Leaks(block_bytes=500, batch_cells=50)])
def test_planted(spark, leaks):
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + k % 26)}{k}" for k in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(rng.randrange(12, 50))) for k in range(40)]
    rows, want = [], set()
    for i in range(300):
        words = text(rng.randrange(5, 400))
        if i % 3 == 0:
            k, item = rng.choice(items)
            copy = list(item)
            for _ in range(len(copy) // 8 if i % 2 else 0):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            at = rng.randrange(len(words))
            words[at:at] = [x.upper() + "," for x in copy]
            want.add((i, k))
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(items[7][1])) for i in range(200)] + [(2000, None), (2001, ""), (2002, " ".join(items[3][1][:3]) + " " + " ".join(text(50)))]
    want |= {(1000 + i, 7) for i in range(200)}
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items] + [(90, None), (91, "one two")], "item_id bigint, text string")
    got = d.apply(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), bench, leaks).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert all(r["score"] == 1.0 for r in got if r["doc_id"] >= 1000)


def test_table_against_all_items(spark, documents):
    """Whole texts against whole items, no seeds."""
    from ledgerloom.llm import textkit

    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    hashes = lambda t: textkit.words(x := np.frombuffer((t or "").encode(), np.uint8), np.array([0, len(x)]), space=textkit.NOT_WORD)[2]
    items = [(r[0], hashes(r[1])) for r in bench.collect()]
    want = set()
    for r in documents.select("doc_id", "text").collect():
        words = hashes(r[1])
        t = np.zeros((len(items), max(len(x) for _, x in items)), np.uint64)
        for k, (_, x) in enumerate(items):
            t[k, : len(x)] = x
        if len(words):
            best = d.align(np.tile(words, (len(items), 1)), t)[0]
            want |= {(r[0], i) for (i, x), b in zip(items, best.tolist()) if b >= len(x)}
    assert {(r["doc_id"], r["item_id"]) for r in d.apply(documents, bench).collect()} == want and want


def test_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "same words here again and again same"), (None, "a row without an id")], "item_id bigint, text string")
    got = d.apply(odd, bench).collect()
    assert sorted(str((r["doc_id"], r["item_id"])) for r in got) == ["(6, 1)", "(7, 1)", "(None, None)"]
    assert d.apply(none, bench).count() == 0 == d.apply(odd, bench.limit(0)).count()


def test_stage_with_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, "same words here again and again same")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = d.stage(spark, odd, str(tmp_path))
    assert out.columns == odd.columns and sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["doc_id"]) for r in odd.collect() if r["doc_id"] not in (6, 7))
    assert d.stage(spark, none, str(tmp_path)).count() == 0


@pytest.mark.parametrize("step", [4, 5])
def test_edits_and_half_copies_against_all_pairs(spark, step):
    """Copies with each nth word changed leave most seeds of an item in no document; half copies hold the common half of its seeds only."""
    rng = random.Random(step)
    vocabulary = [f"w{chr(97 + k % 26)}{k}" for k in range(3000)]
    items = [rng.sample(vocabulary, n) for n in (20, 24, 30, 40, 40, 60)]
    rows = []
    for k, item in enumerate(items[:3]):
        rows.append([f"new{i}" if i % step == step - 1 else w for i, w in enumerate(item)])
    for item in items[3:5]:
        rows += [list(item), item[: len(item) // 2], item[len(item) // 2 :], item[: len(item) // 2 - 1], item[:3]]
    sparse = [x for i, w in enumerate(items[5][:-3]) for x in ([w, "gap", "more"] if i % 2 else [w])] + items[5][-3:]  # one seed, at the end
    rows = [rng.sample(vocabulary, 30) + r + rng.sample(vocabulary, 30) for r in [*rows, sparse]]
    names = {w: i + 1 for i, w in enumerate({w for r in rows for w in r} | set(vocabulary))}
    want = {(i, k) for i, r in enumerate(rows) for k, t in enumerate(items) if slow_align([names[w] for w in r], [names[w] for w in t]) >= len(t)}
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.apply(docs, bench).collect()}
    assert got == want and len(want) == 10
