"""Components by star steps against a plain union of sets."""

import random
from pathlib import Path

import pytest

from ledgerloom.operators.components import components, cut


def plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in list(parent)}


def test_components(spark):
    """A path, a hub near a third of all nodes, random pieces, loops, repeated and turned edges; with heavy nodes and without."""
    rng = random.Random(3)
    name = lambda kind, i: f"{kind}{i:04d}"
    order = list(range(300))
    rng.shuffle(order)
    edges = [(name("p", a), name("p", b)) for a, b in zip(order, order[1:])] + [(name("h", 500), name("h", i)) for i in range(400)] + [(name("h", 7), name("k", 1))]
    edges += [(name("r", rng.randrange(300)), name("r", rng.randrange(300))) for _ in range(180)] + [("x", "x"), ("y", "y"), ("y", "z"), ("z", "y"), ("z", "y")]
    df = spark.createDataFrame(edges, "left_id string, right_id string")
    want = plain(edges)
    for heavy in (20, 10_000):
        got = [tuple(r) for r in components(df.union(spark.createDataFrame([(None, "q"), ("q", None)], df.schema)), heavy=heavy).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert components(df.limit(0)).count() == 0
    assert [tuple(r) for r in components(df.where("left_id = 'x'")).collect()] == [("x", "x")]
    with pytest.raises(RuntimeError):
        components(df, most_rounds=1)


def test_rounds_leave_no_files(spark):
    """A path of 40 edges takes several rounds; only what is returned stays in the checkpoint folder."""
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if spark.sparkContext.getCheckpointDir() else None
    if folder is None:
        cut(spark.range(1))
        folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.rglob("part-*"))
    out = components(spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(40)], "left_id string, right_id string"))
    kept = {p.parent for p in set(folder.rglob("part-*")) - before}
    assert len(kept) == 1 and {r["component"] for r in out.collect()} == {"n00"} and out.count() == 41
