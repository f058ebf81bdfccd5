"""Groups in which greedy loses, against all their assignments; and decisions found by an index."""

from itertools import permutations

from ledgerloom.operators import searches
from ledgerloom.plans import contested

SF = "/root/testdata/sf0.001"


def test_greedy_loses_in_some_groups(spark):
    scored = contested.contested(spark, SF).where("g < 40")
    edges = {}
    for r in scored.where("score > 7000").collect():
        edges.setdefault(r["g"], {})[r["left_id"], r["right_id"]] = r["score"] - 7000
    best = {}
    for g, own in edges.items():
        lefts, rights = sorted({l for l, _ in own}), sorted({r for _, r in own})
        slots = rights + [None] * len(lefts)
        best[g] = max(sum(own.get((l, r), 0) for l, r in zip(lefts, p)) for p in set(permutations(slots, len(lefts))))
    got = {r["g"]: r["objective"] for r in contested.contested_objectives(spark, SF).where("g < 40").collect()}
    assert got == best
    lost = 0
    for g, own in edges.items():
        used, total = set(), 0
        for (l, r), gain in sorted(own.items(), key=lambda x: (-x[1], x[0])):
            if not used & {l, r}:
                used |= {l, r}
                total += gain
        assert total <= best[g]
        lost += total < best[g]
    assert lost > 3
    assert contested._solved(spark, SF).where("g % 5 = 0 and gap = 0").count() > 0, "ties leave nothing certain"


def test_index_of_records(spark, tmp_path):
    schema = "decision_id string, revision int, action string, left_id string, right_id string, record_id string"
    one = spark.createDataFrame([("D1", 1, "CREATE", "a", "b", None), ("D2", 1, "CREATE", None, None, "c"), ("D3", 1, "CREATE", "x", "y", None)], schema)
    two = spark.createDataFrame([("D1", 2, "REPLACE", "a", "z", None), ("D4", 1, "CREATE", "a", "a", None)], schema)
    index = searches.Index(spark, str(tmp_path), 2)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    find = lambda *x, few=1000: sorted(r[0] for r in index.search(ids(*x), few).collect())
    assert find("a") == []
    for batch, history in (("1", one), ("2", two), ("2", two)):
        index.append(history, batch)
    assert len(index.store.names("batches")) == 2
    for few in (1000, 0):
        assert find("b", few=few) == ["D1"], "a record that a later revision no longer names"
        assert find("z", "c", few=few) == ["D1", "D2"] and find("a", few=few) == ["D1", "D4"] and find("q", few=few) == []
    assert find() == []
    now = {r["decision_id"]: (r["revision"], r["action"], r["created"]) for r in searches.listed(one.unionByName(two), index.search(ids("b", "c"))).collect()}
    assert now == {"D1": (2, "REPLACE", 1), "D2": (1, "CREATE", 1)}
    plan = index.search(ids("c"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(record_id)" in plan and "EqualTo(record_id,c)" in plan
    index.append(spark.createDataFrame([("D9", 1, "CREATE", "m", "n", None)], schema), "3")
    assert index.postings_between("a", "c").inputFiles() and not any(index.store.read("batches/3")["folder"] in f for f in index.postings_between("a", "c").inputFiles()), "batches of other ranges are not opened"
