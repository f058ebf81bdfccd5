"""Decision commands, stores that publish once, memberships, passes inside the engine, local times and solvers of one's own."""

from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from test_engine import SCHEMA, record

from ledgerloom.operators import assign, commands, engine, health, memberships, review
from ledgerloom.operators.passes import Pass
from ledgerloom.operators.policy import Matching
from ledgerloom.sources import contract, store
from ledgerloom.sources.store import Projection, RunFacts

NOW = datetime(2026, 9, 7, 12)
HISTORY = "decision_id string, revision int, action string, authority string, left_id string, right_id string"
COMMANDS = "command string, generation int, action string, authority string, left_id string, right_id string, target_id string, target_revision int, approved array<string>"


def test_commands(spark):
    records = spark.createDataFrame([(f"{s}{i}",) for s in "LR" for i in range(1, 10)], "id string")
    history = spark.createDataFrame([("D1", 1, "LINK", "LINK", "L1", "R1"), ("D2", 1, "ACCEPT_UNMATCHED", "ACCEPT_UNMATCHED", "L2", None), ("D3", 1, "LINK", "LINK", "L3", "R3"), ("D3", 2, "REVOKE", "LINK", "L3", "R3"), ("D4", 1, "REJECT_CANDIDATE", "REJECT_CANDIDATE", "L4", "R4")], HISTORY)
    none = spark.createDataFrame([], "decision_id string")

    def c(name, action, authority=None, left=None, right=None, target=None, revision=None, approved=None, generation=7):
        return (name, generation, action, authority, left, right, target, revision, approved)

    sent = [
        c("a0", "LINK", "LINK", "L3", "R3"), c("a1", "LINK", "LINK", "L1", "R5"), c("a2", "LINK", "LINK", "L4", "R4"), c("a3", "ACCEPT_UNMATCHED", "ACCEPT_UNMATCHED", None, "R4"),
        c("a4", "REJECT_CANDIDATE", "REJECT_CANDIDATE", "L1", "R1"), c("a5", "LINK", "LINK", "L99", "R6"), c("a6", "LINK", "LINK", "L7", None), c("a7", "LINK", "LINK", "L7", "R7", generation=6), c("a8", "ACCEPT_UNMATCHED", "ACCEPT_UNMATCHED", "L8", "R8"),
        c("b0", "REVOKE", target="D3", revision=2), c("b1", "REAFFIRM", target="D4", revision=1), c("b2", "REVOKE", target="D1", revision=2), c("b3", "REVOKE", target="D9", revision=1), c("b4", "TELL", target="D4", revision=1),
        c("c1", "REPLACE", "LINK", "L1", "R9", "D4", 1, ["D1@1"]), c("c2", "REPLACE", "LINK", "L2", "R9", "D1", 1, ["D2@1"]), c("c3", "REPLACE", "LINK", "L2", "R8", "D1", 1), c("c4", "REPLACE", "LINK", "L1", "R8", "D1", 1, []),
    ]
    got = commands.judged(spark.createDataFrame(sent, COMMANDS), records, history, none, 7)
    assert {r["command"]: r["code"] for r in got.collect()} == {
        "a0": None, "a1": "ENDPOINT_CLAIMED", "a2": None, "a3": "CONTENDED", "a4": None, "a5": "UNKNOWN_RECORD", "a6": "INVALID_COMMAND", "a7": "STALE_GENERATION", "a8": "INVALID_COMMAND",
        "b0": "STALE_REVISION", "b1": None, "b2": "STALE_REVISION", "b3": "STALE_REVISION", "b4": "INVALID_COMMAND", "c1": "CONTENDED", "c2": "CONTENDED", "c3": "CONFLICT_SET_CHANGED", "c4": "CONTENDED",
    }
    # what takes effect is then the state: D1 goes to another pair, D2 is superseded by it
    new, gone = commands.applied(commands.judged(spark.createDataFrame([sent[15], sent[9]], COMMANDS), records, history, none, 7))
    assert [tuple(r) for r in new.collect()] == [("D1", 2, "REPLACE", "LINK", "L2", "R9")] and [tuple(r) for r in gone.collect()] == [("D2", "D1")]
    after = history.unionByName(new)
    assert sorted(r["decision_id"] for r in review.active(after, gone).collect()) == ["D1", "D4"]
    assert sorted(map(tuple, commands.claims(after, gone).collect())) == [("D1", 2, "L2"), ("D1", 2, "R9")]
    empty = spark.createDataFrame([], COMMANDS)
    assert commands.judged(empty, records, history, none, 7).count() == 0


def test_stale_evidence_is_refused(spark):
    """A command is judged against the records its reviewer saw; what takes effect keeps the digest of those it was made on."""
    observed = lambda amount: spark.createDataFrame([("L1", "L1@1", amount, None), ("R1", "R1@1", "f", "T"), ("L2", "L2@1", "f", None), ("R2", "R2@1", "f", None)], "logical_id string, observation_id string, fingerprint string, reference string")
    ends = spark.createDataFrame([("p", "LINK", "L1", "R1"), ("q", "LINK", "L2", "R2")], "decision_id string, authority string, left_id string, right_id string")
    digests = lambda amount: {r["decision_id"]: r["digest"] for r in health.gathered(ends, observed(amount)).collect()}
    seen, now = digests("old"), digests("new")
    assert seen["q"] == now["q"] and seen["p"] != now["p"]
    history = spark.createDataFrame([("D1", 1, "LINK", "LINK", "L2", "R2")], HISTORY)

    def verdicts(*sent):
        rows = [(n, 7, action, "LINK" if left else None, left, right, target, 1 if target else None, None, digest) for n, action, left, right, target, digest in sent]
        return commands.judged(spark.createDataFrame(rows, COMMANDS + ", seen string"), spark.createDataFrame([("L1",), ("L2",), ("R1",), ("R2",)], "id string"), history, spark.createDataFrame([], "decision_id string"), 7, observed("new"))

    def codes(*sent):
        return [r["code"] for r in verdicts(*sent).orderBy("command").collect()]

    assert codes(("a", "LINK", "L1", "R1", None, seen["p"]), ("b", "REAFFIRM", None, None, "D1", seen["q"])) == ["STALE_EVIDENCE", None]
    assert codes(("a", "LINK", "L1", "R1", None, now["p"]), ("b", "REAFFIRM", None, None, "D1", now["p"])) == [None, "STALE_EVIDENCE"]
    assert codes(("a", "LINK", "L1", "R1", None, None), ("b", "REVOKE", None, None, "D1", now["p"])) == [None, None]  # not told; nothing is decided on records
    # what can't take effect anyway comes first; a stale command doesn't stand in the way of another
    assert codes(("a", "LINK", "L1", "R9", None, "x"), ("b", "LINK", "L1", "R1", None, seen["p"]), ("c", "LINK", "L1", "R1", None, now["p"])) == ["UNKNOWN_RECORD", "STALE_EVIDENCE", None]
    new, _ = commands.applied(verdicts(("a", "LINK", "L1", "R1", None, now["p"]), ("b", "REVOKE", None, None, "D1", None)))
    assert {r["decision_id"]: r["reviewed"] for r in new.collect()} == {"a": now["p"], "D1": None}


def test_stores(spark, tmp_path):
    one = spark.createDataFrame([(1, Decimal("2.50"))], "id int, amount decimal(9,2)")
    facts = RunFacts(spark, f"{tmp_path}/facts")
    assert facts.commit("r1", {"pairs": one, "none": one.limit(0)})["rows"] == {"pairs": 1, "none": 0}
    assert facts.read("r1", "pairs").collect() == one.collect() and facts.read("r1", "none").schema == one.schema
    with pytest.raises(ValueError, match="published before"):
        facts.commit("r1", {"pairs": one})
    with pytest.raises(ValueError, match="another writer"):  # a second attempt that began before the first ended
        facts.store.claim("runs/r1.json", {})
    shown = Projection(spark, f"{tmp_path}/shown")
    with pytest.raises(ValueError, match="nothing"):
        shown.read("s1")
    shown.replace("s1", one, "r1", 3)
    shown.replace("s2", one, "r1", 1)
    shown.replace("s1", one.limit(0), "r2", 4)
    assert shown.read("s1").count() == 0 and shown.read("s2").count() == 1 and shown.head("s1")["run_id"] == "r2"
    with pytest.raises(ValueError, match="stale"):
        shown.replace("s1", one, "r1", 3)
    store.write_raw(one, f"{tmp_path}/raw", "a1")
    with pytest.raises(Exception, match="(?i)exists"):
        store.write_raw(one, f"{tmp_path}/raw", "a1")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/raw").collect()] == [(1, Decimal("2.50"), "a1")]


def test_memberships(spark, tmp_path):
    logicals = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "logical_id string, source string")
    seen = spark.createDataFrame([("o1", "a"), ("o2", "b"), ("o3", "c")], "observation_id string, logical_id string")
    members = lambda *rows: spark.createDataFrame(rows, "logical_id string, observation_id string")
    bad = memberships.problems(members(("a", "o1"), ("a", "o1"), ("b", "o1"), ("c", "o3"), ("x", "o2"), ("b", "o9"), (None, None)), logicals, seen, "s")
    assert sorted((r["what"], r["logical_id"] or "") for r in bad.collect()) == [("MEMBER_TWICE", "a"), ("MEMBER_TWICE", "b"), ("OBSERVATION_OF_ANOTHER_RECORD", "b"), ("RECORD_OF_ANOTHER_SOURCE", "c"), ("UNKNOWN_OBSERVATION", "b"), ("UNKNOWN_RECORD", ""), ("UNKNOWN_RECORD", "x")]
    with pytest.raises(ValueError, match="UNKNOWN_RECORD"):
        memberships.write(members(("x", "o1")), logicals, seen, "s", f"{tmp_path}/m", "1")
    memberships.write(members(("a", "o1"), ("b", "o2")), logicals, seen, "s", f"{tmp_path}/m", "1")
    assert spark.read.parquet(f"{tmp_path}/m").where("revision = 1").count() == 2


def test_passes_inside_the_engine(spark):
    """A pass like the policy's block gives the same result, capped or not; a pass by alias finds a pair that the block can't."""
    rows = [record(f"{side}{i}", "AB"[i % 2], price=str(100 + i), at=NOW + timedelta(minutes=i, seconds=5 * (side == "R"))) for i in range(6) for side in "LR"]
    recs = spark.createDataFrame(rows, SCHEMA)
    for policy in (Matching(), Matching(record_edges=2, run_edges=100), Matching(record_edges=None, run_edges=4)):
        want = sorted(map(tuple, engine.reconcile(recs, policy).outcomes.collect()), key=str)
        assert sorted(map(tuple, engine.reconcile(recs, policy, passes=[Pass("own")]).outcomes.collect()), key=str) == want
    far = [(*record("L1", "A"), "A7"), (*record("R1", "A", at=NOW + timedelta(days=3)), "A7")]
    recs = spark.createDataFrame(far, SCHEMA + ", alias string")
    alone = engine.reconcile(recs, Matching()).outcomes
    assert {r["outcome"] for r in alone.collect()} == {"NO_CANDIDATE"}
    both = engine.reconcile(recs, Matching(), passes=[Pass("own"), Pass("alias", ("alias",), None)])
    assert [(r["left_id"], r["right_id"]) for r in both.scored.collect()] == [("L1", "R1")] and {r["outcome"] for r in both.outcomes.collect()} == {"AMBIGUOUS"}


def test_local_times_that_occur_twice(spark):
    base = contract.counterparty()
    names = ["reference", "executed_at", "symbol", "direction", "qty", "unit_price", "total", "status"]

    def read(zone, fold, *times):
        held = contract.Contract(base.bindings, base.constants, base.enums, time_format="yyyy-MM-dd HH:mm:ss", zone=zone, fold=fold)
        df = spark.createDataFrame([(t, t, "A", "B", "1", "1", "1", "SETTLED") for t in times], ", ".join(f"{n} string" for n in names))
        return {r["source_record_key"]: r["executed_at"] or r["issues"][0].split(":")[1] for r in contract.interpreted(df, held).collect()}

    twice, gap, plain = "2026-11-01 01:30:00", "2026-03-08 02:30:00", "2026-07-01 12:00:00"
    for fold, want in (("EARLIER", datetime(2026, 11, 1, 5, 30)), ("LATER", datetime(2026, 11, 1, 6, 30)), ("REJECT", "AMBIGUOUS_DATETIME")):
        assert read("America/New_York", fold, twice, gap, plain) == {twice: want, gap: "NONEXISTENT_DATETIME", plain: datetime(2026, 7, 1, 16)}
    # half an hour is repeated there; a whole day was left out once
    assert read("Australia/Lord_Howe", "LATER", "2026-04-05 01:45:00", "2026-04-05 01:15:00") == {"2026-04-05 01:45:00": datetime(2026, 4, 4, 15, 15), "2026-04-05 01:15:00": datetime(2026, 4, 4, 14, 15)}
    assert read("Pacific/Apia", "LATER", "2011-12-30 10:00:00", "2011-12-31 10:00:00") == {"2011-12-30 10:00:00": "NONEXISTENT_DATETIME", "2011-12-31 10:00:00": datetime(2011, 12, 30, 20)}
    with pytest.raises(ValueError):
        contract.Contract(base.bindings, base.constants, fold="BOTH")


def test_solvers_are_checked():
    edges = (["a", "a", "b"], ["x", "y", "x"], [9000, 8000, 8500], 7000)
    assert assign.solve(*edges, solver=assign.minimize) == assign.solve(*edges)
    for wrong in (lambda c: np.zeros(len(c), int), lambda c: np.arange(len(c) + 1), lambda c: np.arange(len(c)) - 1, lambda c: np.arange(len(c)) + c.shape[1], lambda c: np.arange(len(c)) * 1.0):
        with pytest.raises(ValueError):
            assign.solve(*edges, solver=wrong)
