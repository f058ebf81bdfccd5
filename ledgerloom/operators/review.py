"""Reviews: folding decisions, health, case keys and lineage, filters, keyset pages and exports."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact

#: Columns of the export, in order.
EXPORT_FIELDS = [
    "export_view", "run_id", "run_freshness", "run_created_at_utc", "case_id", "case_kind", "result_kind",
    "left_reference", "left_executed_at_utc", "left_quantity", "left_unit_price", "left_gross_amount", "left_currency",
    "right_reference", "right_executed_at_utc", "right_quantity", "right_unit_price", "right_gross_amount", "right_currency",
    "pair_origin", "review_health", "review_attention", "review_state_as_of_utc",
]

DECIMALS = "canonical decimal strings"


def active(history: DataFrame, superseded: DataFrame) -> DataFrame:
    """The last revision of each decision that is neither revoked nor superseded."""
    others = [c for c in history.columns if c != "decision_id"]
    last = history.groupBy("decision_id").agg(F.max_by(F.struct(*others), "revision").alias("last")).select("decision_id", "last.*")
    return last.where("action <> 'REVOKE'").join(superseded.select("decision_id").distinct(), "decision_id", "left_anti")


def health() -> Column:
    """Health of a decision from flags endpoints_available, authority, new_candidate, evidence_changed, comparison_changed."""
    return (
        F.when(~F.col("endpoints_available"), "PARTNER_UNAVAILABLE").when((F.col("authority") == "ACCEPT_UNMATCHED") & F.col("new_candidate"), "NEW_CANDIDATE")
        .when(F.col("evidence_changed") | F.col("comparison_changed"), "EVIDENCE_CHANGED").otherwise("UNCHANGED")
    )


def attention() -> Column:
    """What a reviewer should look at, whatever the health: from flags comparison_changed, reference_conflict, search_complete."""
    return F.array_compact(F.array(
        F.when(F.col("comparison_changed"), F.lit("COMPARISON_CHANGED")), F.when(F.col("reference_conflict"), F.lit("AUTHORITATIVE_REFERENCE_CONFLICT")), F.when(~F.col("search_complete"), F.lit("DIAGNOSTIC_INCOMPLETE"))
    ))


def timeline(history: DataFrame) -> DataFrame:
    """``history`` (decision_id, revision, action) with ``previous``, the action before; a decision's revisions are few."""
    return history.withColumn("previous", F.lag("action").over(Window.partitionBy("decision_id").orderBy("revision")))


def offset_page(rows: DataFrame, number: int, *order: str, size: int = 50) -> DataFrame:
    """Page ``number`` (from 1) by offset; for short lists, since all rows before it are sorted too."""
    if isinstance(number, bool) or number < 1 or not 1 <= size <= 200:
        raise ValueError("pages count from 1 and have 1 to 200 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def best(scored: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` candidates with the highest scores, then by ids."""
    return scored.orderBy(F.desc("score"), "left_id", "right_id").limit(n)


def case_key(version: str, kind: str, *parts: tuple[str, Column]) -> Column:
    held = [F.lit(version), F.lit(kind)]
    for label, value in parts:
        held += [F.lit(label), value]
    return exact.prefixed_digest(*held)


def searched(cases: DataFrame, text: str | None = None, kind: str | None = None, over: tuple[str, ...] = ()) -> DataFrame:
    """Cases that hold ``text`` (whatever its case) in one of the columns ``over``, and are of ``kind``."""
    if text is not None:
        if len(text) > 120:
            raise ValueError("at most 120 characters are searched for")
        hit = F.lit(False)
        for c in over:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
        cases = cases.where(hit)
    return cases if kind is None else cases.where(F.col("kind") == kind)


def page(rows: DataFrame, time: str, id_: str, size: int = 50, after: tuple | None = None, descending: bool = False) -> DataFrame:
    """The page of ``size`` rows after a (time, id) key, and one row more that tells whether there is a next page."""
    if isinstance(size, bool) or not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 rows")
    t, i = F.col(time), F.col(id_)
    if after is not None:
        at, key = (F.lit(x) for x in after)
        at = at.cast(rows.schema[time].dataType)
        rows = rows.where(((t < at) | ((t == at) & (i < key))) if descending else ((t > at) | ((t == at) & (i > key))))
    return rows.orderBy(*([t.desc(), i.desc()] if descending else [t, i])).limit(size + 1)


def cursor(filters: dict, key: list) -> str:
    """An opaque cursor, tied to its filters."""
    mark = hashlib.sha256(json.dumps(filters, sort_keys=True).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "f": mark, "k": key}).encode()).decode()


def key_of(text: str, filters: dict) -> list:
    """The key in a cursor; refuses text that is no cursor, and cursors of other filters."""
    try:
        held = json.loads(base64.urlsafe_b64decode(text.encode()))
        version, key = held["v"], held["k"]
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("the cursor is malformed") from error
    if version != 1 or cursor(filters, key) != text:
        raise ValueError("the cursor belongs to other filters")
    return key


def lineage(before: DataFrame, after: DataFrame) -> DataFrame:
    """predecessor, successor: cases of two runs (case_key, members) that differ and share a member."""
    old = before.select(F.col("case_key").alias("predecessor"), F.explode("members").alias("member"))
    new = after.select(F.col("case_key").alias("successor"), F.explode("members").alias("member"))
    return old.join(new, "member").where("predecessor <> successor").select("predecessor", "successor").distinct()


def exported(rows: DataFrame) -> DataFrame:
    """``rows`` with the 23 columns of the export, as text that is safe in a spreadsheet; columns that lack are blank."""
    kinds = dict(rows.dtypes)

    def cell(name: str) -> Column:
        if name not in kinds:
            return F.lit("")
        value = F.col(name)
        text = exact.text_of(value) if kinds[name].startswith("decimal") else exact.instant_of(value) if kinds[name].startswith("timestamp") else value.cast("string")
        return exact.safe_cell(F.coalesce(text, F.lit("")))

    return rows.select(*[cell(n).alias(n) for n in EXPORT_FIELDS])


def write_csv(rows: DataFrame, path: str, *order: str, one_file: bool = False) -> None:
    """The export as CSV with CRLF line ends, in order over its part files. ``one_file``: through one task, for exports that one task can sort."""
    parts = rows.orderBy(*order)
    held = exported(parts.coalesce(1).sortWithinPartitions(*order) if one_file else parts)
    held.write.option("header", True).option("lineSep", "\r\n").mode("overwrite").csv(path)


def write_json(rows: DataFrame, path: str, run_id: str, view: str, *order: str) -> None:
    """The export as ordered JSON lines in ``rows``, then ``head``: view, time zone, encoding of decimals, run and number of rows.

    A head is written last, so a folder without one is no whole export. A folder takes one export and is never written over."""
    spark = rows.sparkSession
    exported(rows.orderBy(*order)).write.mode("error").json(f"{path}/rows")
    total = spark.read.schema("case_id string").json(f"{path}/rows").count()
    head = spark.createDataFrame([(view, "UTC", DECIMALS, run_id, total)], "view string, timezone string, decimal_encoding string, run_id string, total bigint")
    head.coalesce(1).write.mode("error").json(f"{path}/head")


def metrics(found: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: correct, found, truth, and precision, recall and candidate recall in percent (null over nothing)."""
    keys = ["left_id", "right_id"]
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(found.join(truth, keys, "left_semi"), "n_correct").crossJoin(n(found, "n_found")).crossJoin(n(truth, "n_truth")).crossJoin(n(candidates.join(truth, keys, "left_semi"), "n_reached"))
    part = lambda a, b: F.round(100 * F.try_divide(F.col(a), F.col(b)), 4)
    return out.withColumn("precision", part("n_correct", "n_found")).withColumn("recall", part("n_correct", "n_truth")).withColumn("candidate_recall", part("n_reached", "n_truth"))
