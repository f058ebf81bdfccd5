import itertools
import random
from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest

from ledgerloom.operators import assign, engine, references
from ledgerloom.operators.policy import Matching, matching_from_json, to_json

SCHEMA = "rec_side string, id string, reference string, instrument string, side string, currency string, quantity decimal(28,12), unit_price decimal(28,12), gross_amount decimal(28,12), executed_at timestamp, state string"
NOW = datetime(2026, 9, 7, 12)


def record(id_, instrument, reference=None, price="100", state="SETTLED", at=NOW):
    return (id_[0], id_, reference, instrument, "BUY", "USD", Decimal("2"), Decimal(price), Decimal("200"), at, state)


def exhaustive(gain):
    n, m = gain.shape
    best = 0
    for picks in itertools.product(range(-1, m), repeat=n):
        used = [p for p in picks if p >= 0]
        if len(set(used)) == len(used) and all(gain[i, p] > 0 for i, p in enumerate(picks) if p >= 0):
            best = max(best, sum(int(gain[i, p]) for i, p in enumerate(picks) if p >= 0))
    return best


def test_solver_against_exhaustive_search():
    rng = random.Random(4)
    for _ in range(300):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        edges = [(f"L{i}", f"R{j}", rng.randrange(6500, 10001)) for i in range(n) for j in range(m) if rng.random() < 0.7]
        if not edges:
            continue
        total, picked = assign.solve(*map(list, zip(*edges)), 7000)
        other, again = assign.solve(*map(list, zip(*edges)), 7000, assign.minimize)
        assert other == total and again == picked
        gain = np.zeros((n, m), np.int64)
        for l, r, s in edges:
            gain[int(l[1:]), int(r[1:])] = max(0, s - 7000)
        assert total == exhaustive(gain)
        for l, r, without in picked:
            less = gain.copy()
            less[int(l[1:]), int(r[1:])] = 0
            assert without == exhaustive(less)


def test_greedy_would_lose():
    total, picked = assign.solve(["L1", "L1", "L2"], ["R1", "R2", "R1"], [9400, 9200, 9300], 7000)
    assert total == 4500 and {(l, r, total - w) for l, r, w in picked} == {("L1", "R2", 2100), ("L2", "R1", 2100)}


def test_labelled_corpus(spark):
    rows, truth = [], set()
    for i in range(10):
        rows += [record(f"LA{i}", f"AUTH-{i}", f"T-{i}"), record(f"RA{i}", f"AUTH-{i}", f"T-{i}"), record(f"LH{i}", f"HEUR-{i}"), record(f"RH{i}", f"HEUR-{i}")]
        truth |= {(f"LA{i}", f"RA{i}"), (f"LH{i}", f"RH{i}")}
    for g in range(5):
        rows += [record(f"{s}X{g}{x}", f"AMB-{g}") for s in "LR" for x in "ab"]
        rows += [record(f"LN{g}", f"LN-{g}"), record(f"RN{g}", f"RN-{g}")]
    df = spark.createDataFrame(rows, SCHEMA)
    result = engine.reconcile(df)
    assert {(r["left_id"], r["right_id"]) for r in result.pairs.collect()} == truth
    got = {r["id"]: r["outcome"] for r in result.outcomes.collect()}
    assert len(got) == 70 and all(got[f"{s}X{g}{x}"] == "AMBIGUOUS" for s in "LR" for g in range(5) for x in "ab")
    assert all(got[f"{s}N{g}"] == "NO_CANDIDATE" for s in "LR" for g in range(5))
    weighted = [r for r in result.proposals.collect() if r["accepted"]]
    assert len(weighted) == 10 and {(r["score"], r["gap"]) for r in weighted} == {(10000, 3000)}
    assert engine.problems(df, result).count() == 0
    assert result.comparisons.count() == 9 * 20


@pytest.mark.parametrize("policy, kept", [(Matching(record_edges=3), 3), (Matching(run_edges=5), 5), (Matching(record_edges=6), 36)])
def test_caps(spark, policy, kept):
    df = spark.createDataFrame([record(f"{s}{i}", "ONE") for s in "LR" for i in range(6)], SCHEMA)
    result = engine.reconcile(df, policy)
    assert result.scored.count() == kept
    want = "AMBIGUOUS" if kept == 36 else "COMPUTATION_LIMITED"
    assert {r["outcome"] for r in result.outcomes.collect()} == {want}


def test_decisions_and_precedence(spark):
    rows = [record(f"{s}{i}", f"I{i}", "DUP" if i in (6, 7) else f"T{i}" if i == 8 else None, state="CANCELLED" if (s, i) in (("L", 0), ("R", 1)) else "SETTLED") for s in "LR" for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = lambda x: spark.createDataFrame(x, "left_id string, right_id string")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id string")
    decisions = references.Decisions(pairs([("L2", "R3"), ("L1", "R1"), ("Lx", "Rx")]), ids(["L4"]), pairs([("L9", "R9")]), ids(["R5"]))
    result = engine.reconcile(df, decisions=decisions)
    got = {r["id"]: (r["outcome"], r["partner"]) for r in result.outcomes.collect()}
    assert got["L0"][0] == "CANCELLED" and got["R1"][0] == "CANCELLED" and got["L1"][0] == "MANUAL_ATTENTION"
    assert got["L2"] == ("MANUAL_PAIR", "R3") and got["R3"] == ("MANUAL_PAIR", "L2")
    assert got["L4"][0] == "ACCEPTED_UNMATCHED" and got["R5"][0] == "REVIEWER_RESERVED"
    assert {got[f"{s}{i}"][0] for s in "LR" for i in (6, 7)} == {"DUPLICATE_REFERENCE"}
    assert got["L8"] == ("REFERENCE_PAIR", "R8") and got["L9"][0] == "PROHIBITED" == got["R9"][0]
    assert got["R2"][0] == "NO_CANDIDATE" and engine.problems(df, result).count() == 0


def test_decisions_with_absent_ends(spark):
    """A link whose other end is no record reserves its record; a rejection whose other end is none says nothing."""
    df = spark.createDataFrame([record("L1", "A"), record("R2", "B"), record("L3", "C"), record("R4", "D")], SCHEMA)
    pairs = lambda x: spark.createDataFrame(x, "left_id string, right_id string")
    decisions = references.Decisions(pairs([("L1", "Rgone"), ("Lgone", "R2")]), rejected=pairs([("L3", "Rgone")]))
    got = {r["id"]: r["outcome"] for r in engine.reconcile(df, decisions=decisions).outcomes.collect()}
    assert got == {"L1": "REVIEWER_RESERVED", "R2": "REVIEWER_RESERVED", "L3": "NO_CANDIDATE", "R4": "NO_CANDIDATE"}


def test_run_cap_stops_later_blocks_without_edges(spark):
    far = datetime(2026, 9, 20, 12)
    rows = [record(f"{s}{i}", "A") for s in "LR" for i in range(3)] + [record("L7", "B"), record("R7", "B", at=far), record("L8", "C"), record("L9", "0"), record("R9", "0", at=far)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["outcome"] for r in engine.reconcile(df, Matching(run_edges=5)).outcomes.collect()}
    assert {got[x] for x in ("L0", "R2", "L7", "R7")} == {"COMPUTATION_LIMITED"}
    assert {got[x] for x in ("L8", "L9", "R9")} == {"NO_CANDIDATE"}, "no block, or one before the cap was hit"
    whole = {r["id"]: r["outcome"] for r in engine.reconcile(df, Matching(run_edges=9)).outcomes.collect()}
    assert whole["L7"] == "NO_CANDIDATE" and whole["L0"] == "AMBIGUOUS"


def test_contradiction_and_floor(spark):
    rows = [record("L1", "A", "X"), record("R1", "A", "Y"), record("L2", "B"), record("R2", "B", price="150", at=datetime(2026, 9, 7, 20)), record("L3", "C", price="100"), record("R3", "C", price="100.5")]
    result = engine.reconcile(spark.createDataFrame(rows, SCHEMA))
    got = {r["id"]: r["outcome"] for r in result.outcomes.collect()}
    assert got == {"L1": "PROHIBITED", "R1": "PROHIBITED", "L2": "BELOW_ASSIGNMENT_FLOOR", "R2": "BELOW_ASSIGNMENT_FLOOR", "L3": "WEIGHTED_PAIR", "R3": "WEIGHTED_PAIR"}
    score = {r["left_id"]: r["unit_price_bp"] for r in result.scored.collect()}
    assert score["L3"] == 754  # 1500 * (1 - 0.5 / 1.005) = 753.73


def test_policy():
    assert matching_from_json(to_json(Matching())) == Matching()
    with pytest.raises(ValueError):
        Matching(floor=9500)
