"""Full snapshots as an operation: what they change, whether their evidence holds, and their activation.

A snapshot says everything: keys that it leaves out are dropped (a delta keeps them). Rows are compared by fingerprint, in one
join of keys and fingerprints; values aren't read. Before the head moves, the prepared rows are counted and checked again, in one
aggregation by key: as many rows as were previewed, no issues, no key twice or missing, operations only where the mode has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hash_tree
from .components import cut
from .revisions import activation, merged

#: Modes of a dataset, operations of a delta.
SNAPSHOT, DELTA = "SNAPSHOT", "DELTA"
OPERATIONS = ("UPSERT", "CANCEL", "RETRACT")
CHECKS = ("ROW_COUNT", "ROW_ISSUE", "MISSING_KEY", "DUPLICATE_KEY", "OPERATION_FOR_MODE", "STATE_FOR_OPERATION")


def diff(base: DataFrame, snapshot: DataFrame, key: str = "source_record_key", fingerprint: str = "fingerprint") -> DataFrame:
    """key and ``change``: ADDED, CHANGED, DROPPED or UNCHANGED, for every key of either. Keys are unique on both sides."""
    a = base.select(key, F.col(fingerprint).alias("a"), F.lit(True).alias("in_a"))
    b = snapshot.select(key, F.col(fingerprint).alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "ADDED").when(F.col("in_b").isNull(), "DROPPED").when(F.col("a").eqNullSafe(F.col("b")), "UNCHANGED").otherwise("CHANGED")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def checks(rows: DataFrame, mode: str, expected_rows: int, key: str = "source_record_key") -> DataFrame:
    """check, n: how much of the evidence of prepared ``rows`` (key, state, operation, issues) doesn't hold; 0 where it does. A row for each of ``CHECKS``."""
    if mode not in (SNAPSHOT, DELTA):
        raise ValueError("the mode is SNAPSHOT or DELTA")
    op, state = F.col("operation"), F.col("state")
    wrong = op.isNotNull() if mode == SNAPSHOT else ~F.coalesce(op.isin(*OPERATIONS), F.lit(False))
    unlike = F.coalesce((op == "CANCEL") & (state != "CANCELLED"), F.lit(False))
    counted = lambda c: F.count(F.when(c, 1))
    by_key = rows.groupBy(key).agg(F.count("*").alias("rows"), counted(F.size("issues") > 0).alias("issues"), counted(wrong).alias("wrong"), counted(unlike).alias("unlike"))
    missing = F.coalesce(F.trim(F.col(key)) == "", F.lit(True))
    sums = by_key.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("rows", "rows"), ("issues", "ROW_ISSUE"), (F.when(missing, F.col("rows")), "MISSING_KEY"), (F.when(~missing & (F.col("rows") > 1), 1), "DUPLICATE_KEY"), ("wrong", "OPERATION_FOR_MODE"), ("unlike", "STATE_FOR_OPERATION")))
    ).withColumn("ROW_COUNT", F.abs(F.col("rows") - expected_rows))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("n")) for c in CHECKS))).alias("x")).select("x.*")


def activate(store, rows: DataFrame, mode: str, expected_rows: int, expected_base: int, restore_reason: str | None = None, key: str = "source_record_key", values: list[str] | None = None) -> dict:
    """Makes prepared ``rows`` the next revision of ``store`` (``streaming.deltas.Revisions``): {"state": ACTIVATED, NO_CHANGE or REPLAYED, "revision", "digest"}.

    Refuses a base that isn't the head, and evidence that doesn't hold. The digest is the root of the members' hash tree; it is kept with
    the head, so equal states are known again."""
    head = store.head()
    if head["revision"] != expected_base:
        raise ValueError(f"revision {expected_base} is stale; the head is {head['revision']}")
    activation(None, "", set(), restore_reason)  # checks the reason
    rows = cut(rows)
    broken = {r["check"]: r["n"] for r in checks(rows, mode, expected_rows, key).where("n > 0").collect()}
    if broken:
        raise ValueError("the evidence doesn't hold: " + ", ".join(f"{c} {n}" for c, n in sorted(broken.items())))
    members = [c for c in rows.columns if c not in ("operation", "issues")]
    if mode == SNAPSHOT:
        after = rows.select(*members)
    else:
        base = store.read().select(*members) if head["folder"] else rows.select(*members).limit(0)
        after = merged(base, rows.select(*members, "operation"), key)
    after = cut(after)
    digest = hash_tree.root(hash_tree.tree(after, [key], values))
    state = activation(head.get("digest"), digest, store.digests(), restore_reason)
    if state != "ACTIVATE":
        return {"state": state, "revision": head["revision"], "digest": digest}
    return {"state": "ACTIVATED", "revision": store.publish(after, head["batch"], expected_base, digest), "digest": digest}
