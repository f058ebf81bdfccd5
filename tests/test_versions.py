"""Hash trees, snapshots and their activation, identities, heads that are published once, health over two runs."""

import shutil
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hash_tree, health, identities, snapshots
from ledgerloom.sources.store import Projection, Store
from ledgerloom.streaming.deltas import Revisions

NOW = datetime(2026, 9, 7, 12)
TYPES = "id string, amount decimal(38,12), at timestamp, took interval day to second, n int, ok boolean, names array<string>"


def rows(n=300):
    return [(f"id{i}", Decimal(i) / 4, NOW + timedelta(seconds=i), timedelta(seconds=i, microseconds=i), i, i % 2 == 0, [f"a{i}", None]) for i in range(n)]


def test_equal_content_has_one_root(spark):
    df = spark.createDataFrame(rows(), TYPES)
    first = hash_tree.root(hash_tree.tree(df, ["id"]))
    other = df.repartition(7, F.rand(3)).select(*reversed(df.columns)).withColumn("amount", F.col("amount").cast("decimal(20,4)"))
    assert hash_tree.root(hash_tree.tree(other, ["id"])) == first
    for changed in (df.withColumn("n", F.col("n").cast("string")), df.withColumn("took", F.expr("took + interval 1 day")), df.where("n > 0"), df.withColumn("ok", F.when(F.col("n") != 5, F.col("ok"))), df.withColumn("names", F.array(F.col("names")[0]))):
        assert hash_tree.root(hash_tree.tree(changed, ["id"])) != first
    with pytest.raises(ValueError, match="2 rows|1 rows"):
        hash_tree.root(hash_tree.tree(df.unionByName(df.limit(1)), ["id"]))
    with pytest.raises(ValueError, match="canonical form"):
        hash_tree.tree(df.withColumn("x", F.lit(1.5)), ["id"])
    none = hash_tree.tree(df.limit(0), ["id"])
    assert hash_tree.root(none) == hash_tree.root(hash_tree.tree(df.limit(0), ["id"])) and none.nodes.count() == 1


def test_differences_read_changed_branches_only(spark, tmp_path):
    df = spark.createDataFrame(rows(), TYPES)
    changed = df.where("id <> 'id7'").withColumn("amount", F.when(F.col("id") == "id9", F.lit(-1).cast("decimal(38,12)")).otherwise(F.col("amount")))
    changed = changed.unionByName(df.where("id = 'id7'").withColumn("id", F.lit("new")))
    made = hash_tree.tree(df, ["id"])
    hash_tree.saved(made, f"{tmp_path}/a")
    hash_tree.saved(hash_tree.tree(changed, ["id"]), f"{tmp_path}/b")
    want = [("id7", "DROPPED"), ("id9", "CHANGED"), ("new", "ADDED")]
    assert sorted(tuple(r) for r in hash_tree.differences(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["id"]).collect()) == want
    # the answer is the same when all other branches are gone
    tops = {r["top"] for r in hash_tree.tree(df.unionByName(changed.where("id = 'new'")), ["id"]).leaves.where("id in ('id7', 'id9', 'new')").select(F.substring("key", 1, 2).alias("top")).collect()}
    for side in "ab":
        for folder in [*(tmp_path / side / "leaves").glob("top=*"), *(tmp_path / side / "nodes").glob("digits=[46]/top=*")]:
            if folder.name.removeprefix("top=") not in tops:
                shutil.rmtree(folder)
    assert sorted(tuple(r) for r in hash_tree.differences(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["id"]).collect()) == want
    assert hash_tree.differences(spark, f"{tmp_path}/a", f"{tmp_path}/a", ["id"]).count() == 0


PREPARED = "source_record_key string, amount int, state string, operation string, issues array<string>"


def prepared(spark, held, op=None, state="SETTLED"):
    return spark.createDataFrame([(k, v, state, op, []) for k, v in held.items()], PREPARED)


def test_activation(spark, tmp_path):
    store = Revisions(spark, str(tmp_path))
    go = lambda df, n, base, mode=snapshots.SNAPSHOT, why=None: snapshots.activate(store, df, mode, n, base, why)
    first, second = {"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 5, "d": 4}
    assert go(prepared(spark, first), 3, -1)["state"] == "ACTIVATED"
    assert go(prepared(spark, first), 3, 0) | {"digest": 0} == {"state": "NO_CHANGE", "revision": 0, "digest": 0}
    assert go(prepared(spark, second), 3, 0)["revision"] == 1
    assert {r["source_record_key"]: r["amount"] for r in store.read().collect()} == second, "a snapshot drops what it leaves out"
    assert go(prepared(spark, first), 3, 1)["state"] == "REPLAYED" and store.head()["revision"] == 1
    assert go(prepared(spark, first), 3, 1, why="back to the first")["revision"] == 2
    assert go(prepared(spark, {"b": 9}, "UPSERT"), 1, 2, snapshots.DELTA)["revision"] == 3
    assert {r["source_record_key"]: r["amount"] for r in store.read().collect()} == first | {"b": 9}, "a delta keeps it"
    assert go(prepared(spark, {"zz": 9}, "RETRACT"), 1, 3, snapshots.DELTA)["state"] == "NO_CHANGE"
    for df, n, base, mode, why, said in (
        (prepared(spark, first), 3, 1, snapshots.SNAPSHOT, None, "stale"), (prepared(spark, first), 4, 3, snapshots.SNAPSHOT, None, "ROW_COUNT 1"), (prepared(spark, first, "UPSERT"), 3, 3, snapshots.SNAPSHOT, None, "OPERATION_FOR_MODE 3"),
        (prepared(spark, first), 3, 3, snapshots.DELTA, None, "OPERATION_FOR_MODE 3"), (prepared(spark, {"a": 1}).unionByName(prepared(spark, {"a": 2})), 2, 3, snapshots.SNAPSHOT, None, "DUPLICATE_KEY 1"), (prepared(spark, {" ": 1}), 1, 3, snapshots.SNAPSHOT, None, "MISSING_KEY 1"),
        (prepared(spark, first, "CANCEL"), 3, 3, snapshots.DELTA, None, "STATE_FOR_OPERATION 3"), (prepared(spark, first).withColumn("issues", F.array(F.lit("X"))), 3, 3, snapshots.SNAPSHOT, None, "ROW_ISSUE 3"), (prepared(spark, first), 3, 3, snapshots.SNAPSHOT, "", "1 to 1000"), (prepared(spark, first), 3, 3, "ALL", None, "mode"),
    ):
        with pytest.raises(ValueError, match=said):
            go(df, n, base, mode, why)
    assert store.head()["revision"] == 3, "nothing was published by those"
    assert {r["check"]: r["n"] for r in snapshots.checks(prepared(spark, {}), snapshots.SNAPSHOT, 0).collect()} == dict.fromkeys(snapshots.CHECKS, 0)


def test_snapshot_diff(spark):
    frame = lambda held: spark.createDataFrame(list(held.items()), "source_record_key string, fingerprint string")
    got = {r[0]: r[1] for r in snapshots.diff(frame({"a": "1", "b": "2", "c": None, "d": None}), frame({"b": "3", "c": None, "d": "1", "e": None})).collect()}
    assert got == {"a": "DROPPED", "b": "CHANGED", "c": "UNCHANGED", "d": "CHANGED", "e": "ADDED"}


def test_identities_are_made_once(spark, tmp_path):
    store = identities.Identities(spark, str(tmp_path), ["book", "key"])
    frame = lambda *keys: spark.createDataFrame([("b1", k) for k in keys], "book string, key string")
    first = {tuple(r) for r in store.get_or_create(frame("x", "y", "y", None), "one").collect()}
    assert len(first) == 2
    again = {tuple(r) for r in store.get_or_create(frame("x", "y", "y", None), "one").collect()}
    assert again == first and len(store.store.names("attempts")) == 1, "a repeated attempt adds nothing"
    # two attempts at once: both find z missing before either is published
    rival = identities.Identities(spark, str(tmp_path), ["book", "key"])
    known = store.read()
    for name in ("two", "three"):
        identities.missing(known, frame("x", "z"), ["book", "key"]).write.parquet(f"{tmp_path}/data/{name}")
    store.store.claim("attempts/two", {"folder": "data/two"})
    rival.store.claim("attempts/three", {"folder": "data/three"})
    held = store.read().collect()
    assert len(held) == 3 == len({r["identity"] for r in held}) and first < {tuple(r) for r in held}
    assert identities.missing(store.read(), frame("x", "y", "z"), ["book", "key"]).count() == 0
    joined = spark.createDataFrame([("a", "bc"), ("ab", "c")], "book string, key string").select(identities.identity("book", "key").alias("i"))
    assert joined.distinct().count() == 2, "parts of a key don't run together"


def test_heads_are_seen_whole_and_made_once(spark, tmp_path):
    shown = Projection(spark, str(tmp_path))
    frame = lambda n: spark.range(n)
    shown.replace("s", frame(1), "run-1", 1)
    (tmp_path / "heads" / "s" / "000000000001").touch()  # a writer of an older kind died here
    assert shown.read("s").count() == 1
    assert shown.replace("s", frame(2), "run-2", 2)["nth"] == 1 and shown.read("s").count() == 2
    store = Store(spark, str(tmp_path))
    store.claim("claims/x", {"by": 1})
    with pytest.raises(ValueError, match="another writer"):
        store.claim("claims/x", {"by": 2})
    assert store.read("claims/x") == {"by": 1} and store.names("claims") == ["x"] and not list((tmp_path / ".drafts").glob("[!.]*"))
    revisions = Revisions(spark, f"{tmp_path}/r")
    revisions.publish(frame(1), 0, -1)
    with pytest.raises(ValueError):
        revisions.publish(frame(1), 0, -1)


def test_health_of_decisions(spark):
    records = lambda **seen: spark.createDataFrame([(k, f"{k}@{v}", f"print {k} {v}", "T" if k in ("c", "d") else None) for k, v in seen.items()], "logical_id string, observation_id string, fingerprint string, reference string")
    made = spark.createDataFrame([("D1", "LINK", "a", "b"), ("D2", "REJECT_CANDIDATE", "c", "d"), ("D3", "ACCEPT_UNMATCHED", "e", None), ("D4", "ACCEPT_UNMATCHED", "f", None), ("D5", "LINK", "a", "gone")], "decision_id string, authority string, left_id string, right_id string")
    then, now = records(a=1, b=1, c=1, d=1, e=1, f=1, gone=1), records(a=1, b=2, c=1, d=1, e=1, f=1)
    reviewed = made.join(health.gathered(made, then).select("decision_id", F.col("digest").alias("reviewed")), "decision_id")
    told = spark.createDataFrame([("ACCEPTED_UNMATCHED_CANDIDATE", "e@1", True), ("INCOMPLETE_SEARCH", "f@1", False)], "kind string, record_id string, complete boolean")
    got = {r["decision_id"]: (r["health"], r["attention"]) for r in health.projected(reviewed, now, told).collect()}
    assert got == {"D1": ("EVIDENCE_CHANGED", ["COMPARISON_CHANGED"]), "D2": ("UNCHANGED", ["AUTHORITATIVE_REFERENCE_CONFLICT"]), "D3": ("NEW_CANDIDATE", []), "D4": ("UNCHANGED", ["DIAGNOSTIC_INCOMPLETE"]), "D5": ("PARTNER_UNAVAILABLE", [])}
    commands = reviewed.select(F.concat(F.lit("C"), "decision_id").alias("command_id"), "decision_id", F.col("reviewed").alias("seen"))
    assert {r["command_id"] for r in health.stale(commands, made, now).collect()} == {"CD1", "CD5"}
