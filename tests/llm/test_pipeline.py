import random
import re
from collections import Counter

import corpus_pipeline
from ledgerloom.llm import quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def test_stages_against_plain_versions(spark, documents):
    docs, held = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        held.append([r.asDict() for r in docs.collect()])
        if name != "sharding":
            assert docs.columns == documents.columns, name
    rules, unique, clean, mixed, sharded = held

    kept = {r["doc_id"] for r in quality_rules.apply(documents).where("kept").collect()}
    assert {r["doc_id"] for r in rules} == kept

    sets = {r["doc_id"]: shingles(r["text"]) for r in rules}
    near = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) if sets[a] else False
    stay = {r["doc_id"] for r in unique}
    assert not any(near(a, b) for a in stay for b in stay if a < b), "no two that stay are near copies"
    reach = set(stay)
    while more := {b for b in kept - reach if any(near(a, b) for a in reach)}:
        reach |= more
    assert reach == kept, "each that goes is linked with one that stays"

    bench = [" ".join(re.findall(r"\w+", r[1].lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = {r["doc_id"]: " ".join(re.findall(r"\w+", r["text"].lower())) for r in unique}
    leaked = {i for i, t in flat.items() if any(b in t for b in bench)}
    assert leaked and not leaked & {r["doc_id"] for r in clean}
    assert len(unique) - len(clean) <= 2 * len(leaked), "clean documents stay"

    times = Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in clean}
    assert Counter(r["doc_id"] for r in sharded) == times
    slots = Counter((r["shard"], r["slot"]) for r in sharded)
    assert max(slots.values()) == 1 and all(0 <= r["shard"] < 8 for r in sharded)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)


def _long(k):
    rng = random.Random(k)
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(90))


def test_rows_without_ids_and_ids_with_several_texts(spark):
    """Every stage keeps each clean row: null ids, one id with two texts, a repeated row; only copies go."""
    rows = [(None, _long(1), "en", "a", 1), (None, _long(2), "en", "a", 2), (5, _long(3), "en", "a", 3), (5, _long(4), None, "b", 4), (6, _long(5), "en", None, 5)]
    again = [(6, _long(5), "en", None, 5), (9, _long(3), "en", "a", 9), (None, "too short", "en", "a", 2)]
    docs = spark.createDataFrame(rows + again, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    want = sorted(rows, key=str)
    steps = dict(corpus_pipeline.STAGES)
    rules = steps["quality_rules"](spark, docs, SF)
    assert sorted(map(tuple, rules.collect()), key=str) == sorted(rows + again[:2], key=str)
    unique = steps["near_duplicates"](spark, rules, SF)
    assert unique.columns == docs.columns and sorted(map(tuple, unique.collect()), key=str) == want
    clean = steps["decontamination"](spark, unique, SF)
    assert sorted(map(tuple, clean.collect()), key=str) == want
    mixed = [tuple(r) for r in steps["mixing"](spark, clean, SF).collect()]
    assert set(mixed) <= set(want) and max(Counter(mixed).values()) <= 3
    others = [(100 + k, _long(100 + k), "en", "c", k) for k in range(60)]  # a group larger than a whole shard would be split
    sharded = steps["sharding"](spark, docs.unionByName(spark.createDataFrame(others, docs.schema)), SF).collect()
    assert sorted((tuple(r)[:5] for r in sharded), key=str) == sorted(rows + again + others, key=str)
    shards = {}
    for r in sharded:
        assert shards.setdefault(r["text"], r["shard"]) == r["shard"], "equal texts share a shard"


def test_a_leak_under_a_shared_id_takes_no_other_text(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, _long(1)), (None, item + " " + _long(2)), (7, _long(3)), (7, item)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, SF).collect()
    assert sorted((str(r[0]), r[1]) for r in left) == sorted([("None", _long(1)), ("7", _long(3))])


def test_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()
