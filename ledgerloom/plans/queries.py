"""Queries over the test tables and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..operators import assign, candidates, compare, engine, references, review, revisions, scoring
from ..operators.components import cut
from ..operators.policy import Comparing, Matching
from ..sources import contract
from . import testbed

#: Candidate edges are not capped here: the tables' blocks are far over the default run cap.
OPEN = Matching(run_edges=None, record_edges=None)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = testbed.records(spark, sf_dir)
    return scoring.with_records(references.preprocess(recs).pairs.select("left_id", "right_id"), recs)


def field_status(spark, sf_dir):
    """Flagship: pairs by trusted reference, compared field by field."""
    return compare.comparisons(_pairs(spark, sf_dir)).groupBy("field", "status").agg(F.count("*").alias("n"))


def reference_pairs(spark, sf_dir):
    return references.preprocess(testbed.records(spark, sf_dir)).pairs.select("left_id", "right_id")


def comparisons(spark, sf_dir):
    return compare.comparisons(_pairs(spark, sf_dir), Comparing())


def preprocess(spark, sf_dir):
    return references.preprocess(testbed.records(spark, sf_dir)).outcomes


def preprocess_with_decisions(spark, sf_dir):
    recs = testbed.records(spark, sf_dir)
    return references.preprocess(recs, testbed.decisions(recs)).outcomes


def reference_index(spark, sf_dir):
    recs = testbed.records(spark, sf_dir).where("reference is not null")
    return recs.groupBy("reference").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.count("*").alias("n"))


def candidate_edges(spark, sf_dir):
    return candidates.edges(references.preprocess(testbed.records(spark, sf_dir)).remaining, OPEN).select("left_id", "right_id")


def candidate_degrees(spark, sf_dir):
    edges = candidates.edges(references.preprocess(testbed.records(spark, sf_dir)).remaining, OPEN)
    return edges.groupBy("left_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_records"))


def scores(spark, sf_dir):
    recs = testbed.records(spark, sf_dir)
    out = scoring.scored_edges(references.preprocess(recs).remaining, OPEN)
    return out.select("left_id", "right_id", "quantity_bp", "timestamp_bp", "unit_price_bp", "gross_amount_bp", "score", "contradicted", "covered")


def outcomes(spark, sf_dir):
    """The whole engine with decisions: an outcome for each record."""
    recs = testbed.records(spark, sf_dir)
    return engine.reconcile(recs, OPEN, decisions=testbed.decisions(recs)).outcomes


def matched_pairs(spark, sf_dir):
    return engine.reconcile(testbed.records(spark, sf_dir), OPEN).pairs


def contract_problems(spark, sf_dir):
    """Records without exactly one outcome, or in two pairs: none."""
    recs = testbed.records(spark, sf_dir)
    return engine.problems(recs, engine.reconcile(recs, OPEN))


def proposals(spark, sf_dir):
    """Selected edges with objective, gap and the gates that they fail."""
    recs = testbed.records(spark, sf_dir)
    rest = references.preprocess(recs).remaining
    return assign.proposals(scoring.scored_edges(cut(rest), OPEN), spark.createDataFrame([], "block string"), OPEN)[0].drop("component")


def duplicate_lines(spark, sf_dir):
    return revisions.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_linenumber")


def _delta(base: DataFrame) -> DataFrame:
    k = F.col("k")
    op = F.when(k % 10 == 0, "RETRACT").when(k % 10 == 1, "CANCEL").when(k % 10 == 2, "UPSERT")
    old = base.where(k % 10 < 3).select("source_record_key", (k + 1_000_000).alias("k"), F.lit("SETTLED").alias("state"), op.alias("operation"))
    new = base.where(k % 50 == 7).select(F.concat(F.lit("N"), "source_record_key").alias("source_record_key"), "k", "state", F.lit("UPSERT").alias("operation"))
    gone = base.where(k % 50 == 9).select(F.concat(F.lit("G"), "source_record_key").alias("source_record_key"), "k", "state", F.lit("RETRACT").alias("operation"))
    late = base.where(k % 50 == 13).select(F.concat(F.lit("C"), "source_record_key").alias("source_record_key"), "k", F.lit("CANCELLED").alias("state"), F.lit("CANCEL").alias("operation"))
    return old.unionByName(new).unionByName(gone).unionByName(late)


def delta_merge(spark, sf_dir):
    base = testbed.records(spark, sf_dir).where("rec_side = 'L'").select(F.col("id").alias("source_record_key"), "k", "state")
    return revisions.merged(base, _delta(base))


def operation_histogram(spark, sf_dir):
    base = testbed.records(spark, sf_dir).where("rec_side = 'L'").select(F.col("id").alias("source_record_key"), "k", "state")
    held = base.join(_delta(base).select("source_record_key", "operation"), "source_record_key", "left")
    return held.groupBy(F.coalesce("operation", F.lit("UNRESOLVED")).alias("operation")).agg(F.count("*").alias("n"))


def state_digests(spark, sf_dir):
    recs = testbed.records(spark, sf_dir).select("instrument", "id", "state")
    return revisions.state_digests(recs, ["instrument"], ["id", "state"])


def case_keys(spark, sf_dir):
    pairs = reference_pairs(spark, sf_dir)
    return pairs.select("left_id", "right_id", review.case_key("case-v1", "PAIR", ("book", F.lit("book-1")), ("left", F.col("left_id")), ("right", F.col("right_id"))).alias("case_key"))


def case_page(spark, sf_dir):
    """Keyset page after a (time, id) key."""
    recs = testbed.records(spark, sf_dir).select("id", "executed_at")
    return review.page(recs, "executed_at", "id", 50, ("1995-06-01 00:00:00", "L1")).select("id", F.unix_micros("executed_at").alias("at"))


def case_search(spark, sf_dir):
    recs = testbed.records(spark, sf_dir).select("id", "reference", "instrument", F.col("rec_side").alias("kind"))
    return review.searched(recs, "t12", "R", over=("reference", "instrument")).select("id", "reference")


def case_lineage(spark, sf_dir):
    """Cases by reference before, by (key modulo 7, reference) after: an overlap join over members."""
    recs = testbed.records(spark, sf_dir).where("reference is not null")
    cases = lambda key: recs.groupBy(key.alias("case_key")).agg(F.collect_set("id").alias("members"))
    return review.lineage(cases(F.col("reference")), cases(F.concat_ws(":", F.pmod("k", F.lit(7)).cast("string"), "reference")))


def export_rows(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    rows = pairs.select(
        F.lit("run_facts").alias("export_view"), F.concat_ws("|", "left_id", "right_id").alias("case_id"), F.lit("PAIR").alias("case_kind"), F.concat(F.lit("="), "l_reference").alias("left_reference"), F.col("r_reference").alias("right_reference"),
        F.col("l_executed_at").alias("left_executed_at_utc"), F.col("l_quantity").alias("left_quantity"), (-F.col("r_gross_amount")).alias("right_gross_amount"), F.col("l_currency").alias("left_currency"),
    )
    return review.exported(rows).select("export_view", "run_id", "case_id", "left_reference", "right_reference", "left_executed_at_utc", "left_quantity", "right_gross_amount", "left_currency")


def active_decisions(spark, sf_dir):
    recs = testbed.records(spark, sf_dir).where("rec_side = 'L'")
    k = F.col("k")
    times = F.explode(F.sequence(F.lit(1), (k % 3 + 1).cast("int"))).alias("revision")
    history = recs.select(F.col("id").alias("decision_id"), "k", times).withColumn("action", F.when((F.col("k") % 5 == 0) & (F.col("revision") == F.col("k") % 3 + 1), "REVOKE").when(F.col("revision") == 1, "CREATE").otherwise("REAFFIRM"))
    gone = recs.where("k % 17 = 0").select(F.col("id").alias("decision_id"))
    return review.active(history, gone).select("decision_id", "revision", "action")


def import_issues(spark, sf_dir):
    """A source read by its contract, with broken cells: rows for each list of issues."""
    k = F.col("k")
    recs = testbed.records(spark, sf_dir).where("rec_side = 'L'")
    raw = recs.select(
        F.when(k % 29 == 0, F.lit("K")).otherwise(F.col("id")).alias("trade_id"), F.when(k % 31 == 0, F.lit("soon")).otherwise(exact.instant_of(F.col("executed_at"))).alias("traded_at"), F.concat(F.lit(" "), "instrument").alias("instrument"),
        F.when(k % 37 == 0, F.lit("HOLD")).otherwise(F.col("side")).alias("side"), F.when(k % 41 == 0, F.lit("NaN")).when(k % 43 == 0, F.lit("1.0000000000001")).otherwise(exact.text_of(F.col("quantity"))).alias("quantity"),
        F.when(k % 47 == 0, F.lit("")).otherwise(F.lit("1.5")).alias("price"), exact.text_of(F.col("gross_amount")).alias("gross_amount"), "state",
    )
    out = contract.interpreted(raw, contract.ledger())
    return out.groupBy(F.array_join("issues", ",").alias("issues")).agg(F.count("*").alias("n"), F.count(F.when(F.col("eligible"), 1)).alias("n_eligible"))


def event_windows(spark, sf_dir):
    """Tumbling hours of the event table by type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select((F.unix_micros("w.start")).alias("hour"), "event_type", "n")


QUERIES = {f.__name__: f for f in (
    field_status, reference_pairs, comparisons, preprocess, preprocess_with_decisions, reference_index, candidate_edges, candidate_degrees, scores, outcomes, matched_pairs, contract_problems, proposals,
    duplicate_lines, delta_merge, operation_histogram, state_digests, case_keys, case_page, case_search, case_lineage, export_rows, active_decisions, import_issues, event_windows,
)}

_B = f"WITH {testbed.SQL}"
_LIVE = "live AS (SELECT * FROM recs WHERE state <> 'CANCELLED'), refs AS (SELECT reference, count(*) FILTER (rec_side = 'L') AS nl, count(*) FILTER (rec_side = 'R') AS nr, min(id) FILTER (rec_side = 'L') AS lid, min(id) FILTER (rec_side = 'R') AS rid FROM live WHERE reference IS NOT NULL GROUP BY 1)"
_PRE = f"{_B}, {_LIVE}, pre AS (SELECT recs.*, CASE WHEN state = 'CANCELLED' THEN 'CANCELLED' WHEN nl > 1 OR nr > 1 THEN 'DUPLICATE_REFERENCE' WHEN nl = 1 AND nr = 1 THEN 'REFERENCE_PAIR' ELSE 'REMAINING' END AS outcome, lid, rid FROM recs LEFT JOIN refs USING (reference)), pairs AS (SELECT id AS left_id, rid AS right_id FROM pre WHERE outcome = 'REFERENCE_PAIR' AND rec_side = 'L')"
_BOTH = "joined AS (SELECT p.left_id, p.right_id, l.reference AS lref, r.reference AS rref, l.instrument AS li, r.instrument AS ri, l.side AS ls, r.side AS rs, l.currency AS lc, r.currency AS rc, l.quantity AS lq, r.quantity AS rq, l.price_cents AS lp, r.price_cents AS rp, l.cents AS la, r.cents AS ra, l.executed_at AS lt, r.executed_at AS rt FROM pairs p JOIN l ON l.id = p.left_id JOIN r ON r.id = p.right_id)"
_COMPARED = f"""{_PRE}, {_BOTH}, c AS (
 SELECT left_id, right_id, 'reference' AS field, CASE WHEN lref IS NULL OR rref IS NULL THEN 'MISSING' WHEN lref = rref THEN 'EXACT' ELSE 'DISCREPANT' END AS status FROM joined
 UNION ALL SELECT left_id, right_id, 'instrument', CASE WHEN li = ri THEN 'EXACT' ELSE 'DISCREPANT' END FROM joined
 UNION ALL SELECT left_id, right_id, 'side', CASE WHEN ls = rs THEN 'EXACT' ELSE 'DISCREPANT' END FROM joined
 UNION ALL SELECT left_id, right_id, 'currency', CASE WHEN lc = rc THEN 'EXACT' ELSE 'DISCREPANT' END FROM joined
 UNION ALL SELECT left_id, right_id, 'quantity', CASE WHEN lq IS NULL OR rq IS NULL THEN 'MISSING' WHEN lq = rq THEN 'EXACT' ELSE 'DISCREPANT' END FROM joined
 UNION ALL SELECT left_id, right_id, 'timestamp', CASE WHEN lt = rt THEN 'EXACT' WHEN abs(epoch_us(lt) - epoch_us(rt)) <= 60000000 THEN 'WITHIN_TOLERANCE' ELSE 'DISCREPANT' END FROM joined
 UNION ALL SELECT left_id, right_id, 'unit_price', CASE WHEN lc <> rc THEN 'NOT_COMPARABLE' WHEN lp IS NULL OR rp IS NULL THEN 'MISSING' WHEN lp = rp THEN 'EXACT' WHEN abs(lp - rp) <= 1 THEN 'WITHIN_TOLERANCE' ELSE 'DISCREPANT' END FROM joined
 UNION ALL SELECT left_id, right_id, 'gross_amount', CASE WHEN lc <> rc THEN 'NOT_COMPARABLE' WHEN la = ra THEN 'EXACT' WHEN abs(la - ra) <= 5 THEN 'WITHIN_TOLERANCE' ELSE 'DISCREPANT' END FROM joined
 UNION ALL SELECT left_id, right_id, 'state', 'EXACT' FROM joined)"""
def _share(weight: int, difference: str, border: str) -> str:
    """Half-even in whole numbers."""
    n = f"(CAST({weight} AS HUGEINT) * greatest(0, ({border}) - ({difference})))"
    q, m = f"({n} // ({border}))", f"({n} % ({border}))"
    return f"CAST({q} + CASE WHEN 2 * {m} > ({border}) OR (2 * {m} = ({border}) AND {q} % 2 = 1) THEN 1 ELSE 0 END AS INTEGER)"


#: Links, accepted, reserved and rejected as ``testbed.decisions`` makes them. A linked left record whose right end is absent is reserved.
_DECIDED = f"""{_B}, early AS (SELECT recs.*, CASE WHEN recs.state = 'CANCELLED' THEN 'CANCELLED' WHEN recs.k % 101 = 0 AND o.id IS NOT NULL THEN 'MANUAL_PAIR'
 WHEN recs.rec_side = 'L' AND recs.k % 103 = 0 AND recs.k % 101 <> 0 THEN 'ACCEPTED_UNMATCHED' WHEN (recs.id[1] = 'R' AND recs.k % 109 = 0) OR (recs.id[1] = 'L' AND recs.k % 101 = 0) THEN 'REVIEWER_RESERVED' END AS early, o.id AS other
 FROM recs LEFT JOIN recs o ON o.k = recs.k AND recs.id[1] IN ('L', 'R') AND o.id = CASE recs.rec_side WHEN 'L' THEN 'R' ELSE 'L' END || recs.k AND o.state <> 'CANCELLED'),
 refs AS (SELECT reference, count(*) FILTER (rec_side = 'L') AS nl, count(*) FILTER (rec_side = 'R') AS nr, min(id) FILTER (rec_side = 'L') AS lid, min(id) FILTER (rec_side = 'R') AS rid, min(k) FILTER (rec_side = 'L') AS lk, min(k) FILTER (rec_side = 'R') AS rk FROM early WHERE early IS NULL AND reference IS NOT NULL GROUP BY 1),
 pre AS (SELECT early.* EXCLUDE (other), coalesce(early, CASE WHEN nl > 1 OR nr > 1 THEN 'DUPLICATE_REFERENCE' WHEN nl = 1 AND nr = 1 AND NOT (lk = rk AND lk % 107 = 0) THEN 'REFERENCE_PAIR' ELSE 'REMAINING' END) AS outcome,
 CASE WHEN early = 'MANUAL_PAIR' THEN other WHEN early IS NULL AND nl = 1 AND nr = 1 AND NOT (lk = rk AND lk % 107 = 0) THEN CASE rec_side WHEN 'L' THEN rid ELSE lid END END AS partner FROM early LEFT JOIN refs USING (reference))"""


_EDGES_OF = "rest AS (SELECT * FROM pre WHERE outcome = 'REMAINING'), e AS (SELECT a.id AS left_id, b.id AS right_id, a.k AS lk, a.quantity AS lq, b.quantity AS rq, a.price_cents AS lp, b.price_cents AS rp, a.cents AS la, b.cents AS ra, epoch_us(a.executed_at) AS lt, epoch_us(b.executed_at) AS rt, a.reference AS lref, b.reference AS rref FROM rest a JOIN rest b ON a.rec_side = 'L' AND b.rec_side = 'R' AND a.instrument = b.instrument AND a.side = b.side AND a.currency = b.currency AND b.executed_at BETWEEN a.executed_at - INTERVAL 24 HOUR AND a.executed_at + INTERVAL 24 HOUR)"
_SCORED = f"""f AS (SELECT left_id, right_id, CASE WHEN lq IS NULL OR rq IS NULL THEN 0 ELSE {_share(3500, "abs(lq - rq) * 100", "greatest(lq, rq)")} END AS quantity_bp, {_share(2500, "abs(lt - rt)", "600000000")} AS timestamp_bp,
 CASE WHEN lp IS NULL OR rp IS NULL THEN 0 ELSE {_share(1500, "abs(lp - rp) * 100", "greatest(100, lp, rp)")} END AS unit_price_bp, {_share(2500, "abs(la - ra) * 100", "greatest(100, la, ra)")} AS gross_amount_bp,
 coalesce(lref <> rref, false) AS contradicted, lq IS NOT NULL AND rq IS NOT NULL AS covered FROM e), s AS (SELECT *, quantity_bp + timestamp_bp + unit_price_bp + gross_amount_bp AS score FROM f)"""
#: Every component above the floor is a star here (one left record and its rivals, or the like): its best edge is selected, and the gap is to the second best.
_CHOSEN = """above AS (SELECT *, count(*) OVER (PARTITION BY left_id) AS dl, count(*) OVER (PARTITION BY right_id) AS dr FROM s WHERE score > 7000),
 star AS (SELECT *, CASE WHEN dr > 1 THEN right_id ELSE left_id END AS center, CAST(score - 7000 AS BIGINT) AS gain FROM above),
 best AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY score DESC) AS place, gain - coalesce(lead(gain) OVER (PARTITION BY center ORDER BY score DESC), 0) AS gap FROM star),
 chosen AS (SELECT left_id, right_id, gain AS objective, gap, score, covered, contradicted, concat_ws(',', CASE WHEN score < 9000 THEN 'SCORE' END, CASE WHEN NOT covered THEN 'COVERAGE' END, CASE WHEN contradicted THEN 'CONTRADICTION' END, CASE WHEN gap < 800 THEN 'GAP' END) AS failing FROM best WHERE place = 1)"""

_DELTA = f"{_B}, d AS (SELECT id, k, state, CASE k % 10 WHEN 0 THEN 'RETRACT' WHEN 1 THEN 'CANCEL' WHEN 2 THEN 'UPSERT' END AS op FROM l)"
_EIGHT = lambda x: f"unhex(lpad(printf('%x', strlen({x})), 16, '0') || hex(encode({x})))"


def _digest(*parts: str) -> str:
    return f"sha256({' || '.join(_EIGHT(p) for p in parts)})"


ORACLE_SQL = {
    "field_status": f"{_COMPARED} SELECT field, status, count(*) AS n FROM c GROUP BY 1, 2",
    "reference_pairs": f"{_PRE} SELECT * FROM pairs",
    "comparisons": f"{_COMPARED} SELECT * FROM c",
    "preprocess": f"{_PRE} SELECT rec_side, id, outcome, CASE WHEN outcome = 'REFERENCE_PAIR' THEN CASE rec_side WHEN 'L' THEN rid ELSE lid END END AS partner FROM pre",
    "preprocess_with_decisions": f"{_DECIDED} SELECT rec_side, id, outcome, partner FROM pre",
    "reference_index": f"{_B} SELECT reference, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM recs WHERE reference IS NOT NULL GROUP BY 1",
    "candidate_edges": f"{_PRE}, {_EDGES_OF} SELECT left_id, right_id FROM e",
    "candidate_degrees": f"{_PRE}, {_EDGES_OF}, d AS (SELECT left_id, count(*) AS n FROM e GROUP BY 1) SELECT n, count(*) AS n_records FROM d GROUP BY 1",
    "scores": f"{_PRE}, {_EDGES_OF}, {_SCORED} SELECT left_id, right_id, quantity_bp, timestamp_bp, unit_price_bp, gross_amount_bp, score, contradicted, covered FROM s",
    "proposals": f"{_PRE}, {_EDGES_OF}, {_SCORED}, {_CHOSEN} SELECT *, failing = '' AS accepted FROM chosen",
    "matched_pairs": f"{_PRE}, {_EDGES_OF}, {_SCORED}, {_CHOSEN} SELECT left_id, right_id, 'REFERENCE_PAIR' AS origin, CAST(NULL AS INTEGER) AS score FROM pairs UNION ALL SELECT left_id, right_id, 'WEIGHTED_PAIR', score FROM chosen WHERE failing = ''",
    "outcomes": f"""{_DECIDED}, {_EDGES_OF.replace("INTERVAL 24 HOUR)", "INTERVAL 24 HOUR AND NOT (a.k = b.k AND b.id[1] = 'R' AND a.k % 107 = 0))")}, {_SCORED}, {_CHOSEN},
 seen AS (SELECT id, min(CAST(contradicted AS INTEGER)) AS contradicted, max(score) AS top FROM (SELECT left_id AS id, contradicted, score FROM s UNION ALL SELECT right_id, contradicted, score FROM s) GROUP BY 1),
 matched AS (SELECT left_id AS id, right_id AS other FROM chosen WHERE failing = '' UNION ALL SELECT right_id, left_id FROM chosen WHERE failing = '')
 SELECT pre.rec_side, pre.id, CASE WHEN pre.outcome <> 'REMAINING' THEN pre.outcome WHEN other IS NOT NULL THEN 'WEIGHTED_PAIR' WHEN top IS NULL AND pre.k % 107 = 0 AND pre.k % 11 <> 0 AND pre.id[1] <> 'Q' THEN 'PROHIBITED' WHEN top IS NULL THEN 'NO_CANDIDATE'
 WHEN contradicted = 1 THEN 'PROHIBITED' WHEN top <= 7000 THEN 'BELOW_ASSIGNMENT_FLOOR' ELSE 'AMBIGUOUS' END AS outcome, coalesce(pre.partner, other) AS partner
 FROM pre LEFT JOIN seen USING (id) LEFT JOIN matched USING (id)""",
    "state_digests": f"""{_B}, d AS (SELECT instrument, {_digest("id", "state")} AS h FROM recs), slices AS (SELECT instrument, h[1:2] AS slice, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS c FROM d GROUP BY 1, 2)
 SELECT instrument, CAST(sum(c) AS BIGINT) AS n_rows, sha256(string_agg(d, '' ORDER BY slice)) AS digest FROM slices GROUP BY 1""",
    "import_issues": f"""{_B}, i AS (SELECT state, concat_ws(',', CASE WHEN k % 31 = 0 THEN 'executed_at:INVALID_DATETIME' END, CASE WHEN k % 41 = 0 THEN 'quantity:NON_FINITE_DECIMAL' WHEN k % 43 = 0 THEN 'quantity:UNSUPPORTED_PRECISION' END,
 CASE WHEN k % 37 = 0 THEN 'side:UNKNOWN_ENUM' END, CASE WHEN k % 29 = 0 THEN 'source_record_key:DUPLICATE_SOURCE_KEY' END, CASE WHEN k % 47 = 0 THEN 'unit_price:EMPTY_VALUE' END) AS issues FROM l)
 SELECT issues, count(*) AS n, count(*) FILTER (issues = '' AND state <> 'CANCELLED') AS n_eligible FROM i GROUP BY 1""",
    "contract_problems": "SELECT 'x' AS what, 'x' AS id WHERE false",
    "duplicate_lines": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "delta_merge": f"{_DELTA} SELECT id AS source_record_key, CASE WHEN op IN ('UPSERT', 'CANCEL') THEN k + 1000000 ELSE k END AS k, CASE WHEN op = 'UPSERT' THEN 'SETTLED' WHEN op = 'CANCEL' THEN 'CANCELLED' ELSE state END AS state FROM d WHERE coalesce(op, '') <> 'RETRACT' UNION ALL SELECT 'N' || id, k, state FROM l WHERE k % 50 = 7 UNION ALL SELECT 'C' || id, k, 'CANCELLED' FROM l WHERE k % 50 = 13",
    "operation_histogram": f"{_DELTA} SELECT coalesce(op, 'UNRESOLVED') AS operation, count(*) AS n FROM d GROUP BY 1",
    "case_keys": f"""{_PRE} SELECT left_id, right_id, {_digest("'case-v1'", "'PAIR'", "'book'", "'book-1'", "'left'", "left_id", "'right'", "right_id")} AS case_key FROM pairs""",
    "case_page": f"{_B} SELECT id, epoch_us(executed_at) AS at FROM recs WHERE executed_at > TIMESTAMP '1995-06-01' OR (executed_at = TIMESTAMP '1995-06-01' AND id > 'L1') ORDER BY executed_at, id LIMIT 51",
    "case_search": f"{_B} SELECT id, reference FROM recs WHERE rec_side = 'R' AND (contains(lower(reference), 't12') OR contains(lower(instrument), 't12'))",
    "case_lineage": f"{_B} SELECT DISTINCT reference AS predecessor, (k % 7) || ':' || reference AS successor FROM recs WHERE reference IS NOT NULL",
    "export_rows": f"""{_PRE}, {_BOTH} SELECT 'run_facts' AS export_view, '' AS run_id, left_id || '|' || right_id AS case_id, '''=' || lref AS left_reference, rref AS right_reference,
 strftime(lt, '%Y-%m-%dT%H:%M:%S.%fZ') AS left_executed_at_utc, CAST(lq AS VARCHAR) AS left_quantity, '''-' || (ra // 100) || CASE WHEN ra % 100 = 0 THEN '' WHEN ra % 10 = 0 THEN '.' || ((ra % 100) // 10) ELSE '.' || lpad(CAST(ra % 100 AS VARCHAR), 2, '0') END AS right_gross_amount, lc AS left_currency FROM joined""",
    "active_decisions": f"{_B} SELECT id AS decision_id, CAST(k % 3 + 1 AS INTEGER) AS revision, CASE WHEN k % 3 = 0 THEN 'CREATE' ELSE 'REAFFIRM' END AS action FROM l WHERE k % 5 <> 0 AND k % 17 <> 0",
    "event_windows": "SELECT epoch_us(date_trunc('hour', CAST(ts AS TIMESTAMP))) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
