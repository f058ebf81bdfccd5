from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.operators import review, revisions
from ledgerloom.sources import contract, delimited
from ledgerloom.streaming.deltas import Revisions

HEAD = ["trade_id", "traded_at", "instrument", "side", "quantity", "price", "gross_amount", "state"]


def rows_of(spark, rows, columns=HEAD):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def test_contract(spark):
    good = ("k1", "2026-09-07T12:00:00Z", "BTC", "BUY", "2.5", "0.000000000001", "1E+15", "SETTLED")
    cases = {
        "k2": ({4: "NaN"}, "quantity:NON_FINITE_DECIMAL"), "k3": ({4: "not-money"}, "quantity:INVALID_DECIMAL"), "k4": ({4: "1.1234567890123"}, "quantity:UNSUPPORTED_PRECISION"),
        "k5": ({3: "HOLD", 5: ""}, "side:UNKNOWN_ENUM,unit_price:EMPTY_VALUE"), "k6": ({1: "2026-09-07 12:00"}, "executed_at:INVALID_DATETIME"), "k7": ({6: "-1"}, "gross_amount:NEGATIVE_VALUE"), "k8": ({2: None}, "instrument:MISSING_VALUE"), "k9": ({6: "1E+25"}, "gross_amount:UNSUPPORTED_PRECISION"), "k10": ({4: "1_000.5", 5: "1E-13"}, "unit_price:UNSUPPORTED_PRECISION"),
    }
    rows = [good, ("twice", *good[1:]), (" twice ", *good[1:])] + [tuple(change.get(i, k if i == 0 else v) for i, v in enumerate(good)) for k, (change, _) in cases.items()]
    got = {(r["source_record_key"], ",".join(r["issues"])) for r in contract.interpreted(rows_of(spark, rows), contract.ledger()).collect()}
    assert got == {("k1", ""), ("twice", "source_record_key:DUPLICATE_SOURCE_KEY")} | {(k, want) for k, (_, want) in cases.items()}
    assert contract.from_json(contract.to_json(contract.counterparty())) == contract.counterparty()
    with pytest.raises(ValueError):
        contract.Contract({"side": "x"})


def test_daylight_saving(spark):
    held = contract.Contract(contract.counterparty().bindings, contract.counterparty().constants, contract.counterparty().enums, time_format="yyyy-MM-dd HH:mm:ss", zone="America/New_York")
    rows = [(t, t, "A", "B", "1", "1", "1", "SETTLED") for t in ("2026-11-01 01:30:00", "2026-03-08 02:30:00", "2026-07-01 12:00:00")]
    df = rows_of(spark, rows, ["reference", "executed_at", "symbol", "direction", "qty", "unit_price", "total", "status"])
    got = {r["source_record_key"]: (r["issues"], r["executed_at"]) for r in contract.interpreted(df, held).collect()}
    assert got["2026-11-01 01:30:00"][0] == ["executed_at:AMBIGUOUS_DATETIME"] and got["2026-03-08 02:30:00"][0] == ["executed_at:NONEXISTENT_DATETIME"]
    assert got["2026-07-01 12:00:00"] == ([], datetime(2026, 7, 1, 16))


def test_delimited(spark, tmp_path):
    files = {"a.csv": b'\xef\xbb\xbfx,y\n1,"a\nb"\n\n2\n3,,z\n', "b.csv": b"x\n\xff\n", "c.csv": b"\xef\xbb\xbf\n", "d.csv": b'x\n"open', "e.csv": b"x\n" + b"1\n" * 5}
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    got = delimited.read(spark, str(tmp_path), limits=delimited.Limits(most_rows=4))
    assert {r["path"][-5:]: r["failure"] for r in got.where("failure is not null").collect()} == {"b.csv": "INVALID_ENCODING", "c.csv": "EMPTY_FILE", "d.csv": "MALFORMED_CSV", "e.csv": "TOO_MANY_ROWS"}
    rows = delimited.columns(got, ["x", "y"]).orderBy("row_number").collect()
    assert [(r["row_number"], r["x"], r["y"], r["extra"]) for r in rows] == [(2, "1", "a\nb", []), (3, None, None, []), (4, "2", None, []), (5, "3", "", ["z"])]
    assert delimited.header_issues(["a", "a"], ["b"]) == ["a:DUPLICATE_HEADER", "b:MISSING_COLUMN"]


def test_deltas_and_stream(spark, tmp_path):
    base = spark.createDataFrame([("a", 1, "SETTLED"), ("b", 2, "SETTLED"), ("c", 3, "SETTLED")], "source_record_key string, v int, state string")
    kind = "source_record_key string, v int, state string, operation string"
    first = spark.createDataFrame([("a", 9, "SETTLED", "UPSERT"), ("b", 7, "CANCELLED", "CANCEL"), ("c", None, None, "RETRACT"), ("d", 4, "SETTLED", "UPSERT"), ("e", 5, "CANCELLED", "CANCEL"), ("zz", None, None, "RETRACT")], kind)
    want = [("a", 9, "SETTLED"), ("b", 7, "CANCELLED"), ("d", 4, "SETTLED"), ("e", 5, "CANCELLED")]
    assert sorted(map(tuple, revisions.merged(base, first).collect())) == want
    store = Revisions(spark, f"{tmp_path}/store")
    store.publish(base, -1, -1)
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        store.follow(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, store.read().collect())) == want and {k: store.head()[k] for k in ("revision", "batch")} == {"revision": 1, "batch": 0}
    store.fold(first, 0)
    assert store.head()["revision"] == 1
    with pytest.raises(ValueError):
        store.publish(base, 5, 0)
    with pytest.raises(ValueError):  # a writer that read the head before another published
        store._claim(1, "{}")
    assert store.head()["batch"] == 0


def test_rows_that_need_less_or_more(spark):
    """RETRACT needs a key only; CANCEL needs a cancelled state; rows without a key are marked once each and never as copies."""
    held = contract.Contract({**contract.ledger().bindings, "operation": "op"}, {"currency": "USD"}, contract.ledger().enums)
    rest = ("2026-09-07T12:00:00Z", "BTC", "BUY", "2", "1", "2")
    rows = [("k1", None, None, None, None, None, None, None, "RETRACT"), ("k2", *rest, "SETTLED", "CANCEL"), ("k3", *rest, "CANCELLED", "CANCEL"), (None, *rest, "SETTLED", "UPSERT"), (None, *rest, "SETTLED", "UPSERT"), (None, None, None, None, None, None, None, None, "RETRACT")]
    got = sorted((r["source_record_key"] or "", ",".join(r["issues"]), r["eligible"]) for r in contract.interpreted(rows_of(spark, rows, [*HEAD, "op"]), held).collect())
    missing = ("", "source_record_key:MISSING_VALUE", False)
    assert got == [missing, missing, missing, ("k1", "", False), ("k2", "state:CANCEL_REQUIRES_CANCELLED", False), ("k3", "", False)]


def test_digests_and_activation(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id", F.lit("x").alias("t"))
    digest = lambda d: {r["g"]: r["digest"] for r in revisions.state_digests(d, ["g"], ["id", "t"]).collect()}
    one = digest(df)
    assert digest(df.repartition(7)) == one and digest(df.union(df.limit(1)))[0] != one[0]
    assert [revisions.activation(h, "x", {"x", "y"}, r) for h, r in (("x", None), ("y", None), ("y", "why"))] == ["NO_CHANGE", "REPLAYED", "ACTIVATE"]


def test_review(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", datetime(2026, 1, 1)), (2, "b", datetime(2026, 1, 1)), (3, "C_%", datetime(2026, 1, 2))], "id int, name string, at timestamp")
    assert [r["id"] for r in review.page(df, "at", "id", 1, (datetime(2026, 1, 1), 1)).collect()] == [2, 3]
    assert [r["id"] for r in review.page(df, "at", "id", 1, descending=True).collect()] == [3, 2]
    assert review.searched(df, "c_%", over=("name",)).count() == 1 == review.searched(df, "A", over=("name",)).count()
    key = review.cursor({"kind": "PAIR"}, ["t", "i"])
    assert review.key_of(key, {"kind": "PAIR"}) == ["t", "i"]
    with pytest.raises(ValueError):
        review.key_of(key, {"kind": "UNPAIRED"})
    rows = spark.createDataFrame([("=1+1", Decimal("-2.500000000000"), datetime(2026, 1, 1, 2, 3, 4))], "case_id string, left_quantity decimal(38,12), left_executed_at_utc timestamp")
    out = review.exported(rows).first()
    assert (out["case_id"], out["left_quantity"], out["left_executed_at_utc"], out["run_id"]) == ("'=1+1", "'-2.5", "2026-01-01T02:03:04.000000Z", "")
    history = spark.createDataFrame([("d1", 1, "CREATE"), ("d1", 2, "REVOKE"), ("d2", 1, "CREATE"), ("d3", 1, "CREATE")], "decision_id string, revision int, action string")
    gone = spark.createDataFrame([("d3",)], "decision_id string")
    assert [r["decision_id"] for r in review.active(history, gone).collect()] == ["d2"]
    m = review.metrics(*(spark.createDataFrame(x, "left_id int, right_id int") for x in ([(1, 1), (2, 3)], [(1, 1), (2, 2), (3, 3)], [(1, 1), (2, 2)]))).first()
    assert (m["precision"], m["recall"], m["candidate_recall"]) == (50.0, 33.3333, 66.6667)


def test_half_even(spark):
    d = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
    got = spark.range(1).select(*[exact.share(w, d(a), d(b)).alias(f"c{i}") for i, (w, a, b) in enumerate([(3500, 0, 0), (3500, 1, 0), (1, 1, 2), (3, 1, 2), (5, 1, 2), (2500, 1, 3), (10, 9, 3)])]).first()
    assert list(got) == [3500, 0, 0, 2, 2, 1667, 0]
