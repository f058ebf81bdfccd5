import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import quality_classifier, toxicity

SF = "/root/testdata/sf0.1"


def auc(pairs):
    line = sorted(pairs)
    good = bad = won = 0
    k = 0
    while k < len(line):
        same, j = [], k
        while j < len(line) and line[j][0] == line[k][0]:
            same.append(line[j][1])
            j += 1
        won += sum(same) * (bad + (len(same) - sum(same)) / 2)
        good, bad, k = good + sum(same), bad + len(same) - sum(same), j
    return won / (good * bad)


@pytest.mark.parametrize("operator, label, least", [(toxicity, "toxic", 0.95), (quality_classifier, "quality", 0.97)])
def test_held_out(spark, operator, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = operator.apply(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = np.mean([r["predicted"] == r[label] for r in rows])
    area = auc([(r["score"], r[label]) for r in rows])
    print(label, len(rows), "accuracy", right, "area", area)
    assert right > 0.95 and area > least


def test_pairs_of_terms(spark):
    """Neither term alone is toxic, both together are."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(4000):
        words = [f"w{rng.randrange(200)}" for _ in range(30)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["insult"] * insult + ["group"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    z, n, v, _ = toxicity.model(docs, marks, toxicity.Machine())
    terms = [next(iter(toxicity._terms(18)(np.frombuffer(w, np.uint8), np.array([0, len(w)]))))[0] for w in (b"insult", b"group")]
    assert v[terms[0]] @ v[terms[1]] > 0.3
    got = toxicity.apply(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_odd(spark, odd, none, operator, label):
    labels = spark.createDataFrame([(6, 1), (6, 1), (8, 0), (9, 1), (None, 1), (11, None), (99, 0), (1, 0), (4, 1)], f"doc_id bigint, {label} int")
    rows = operator.apply(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    again = operator.apply(odd.repartition(3), labels).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in rows) == sorted((str(r["doc_id"]), r["score"]) for r in again)
    assert operator.apply(none, labels).count() == 0
    assert {r["score"] for r in operator.apply(odd, labels.limit(0)).collect()} == {0.5}
