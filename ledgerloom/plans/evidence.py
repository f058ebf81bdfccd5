"""More queries over the test tables: blocking passes, codes, cases, evidence and strategies, with the same in DuckDB's SQL."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, exact, labels
from ..operators import assign, candidates, cases, commands, compare, diagnostics, engine, evaluation, memberships, references, review, scoring
from ..operators.components import cut
from ..operators.passes import Pass, generate
from ..operators.policy import Comparing, Matching
from . import testbed
from .queries import ORACLE_SQL as queries_sql
from .queries import _B, _BOTH, _CHOSEN, _DECIDED, _EDGES_OF, _EIGHT, _PRE, _SCORED, OPEN

PASSES = [Pass("general"), Pass("alias", ("instrument", "alias"), None), Pass("any-side", ("instrument", "currency"), 3600, "2")]
BOOK, SCOPE, POLICY_DIGEST = "book-1", "scope-1", "0" * 64


def _aliased(recs: DataFrame) -> DataFrame:
    """Aliases of two neighbouring keys each; every ninth record has none, some of the right have their neighbours'."""
    k = F.col("k")
    near = F.floor((k + F.when((F.col("rec_side") == "R") & (k % 29 == 0), 2).otherwise(0)) / 2).cast("bigint").cast("string")
    return recs.withColumn("alias", F.when(k % 9 != 0, F.concat(F.lit("A"), near)))


class _Run:
    """The stages of the engine without decisions and caps, each when it is asked for. Candidates are made anew by each reader, those above the floor are kept."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.recs = testbed.records(spark, sf_dir)
        self.pre = references.preprocess(self.recs)

    @cached_property
    def remaining(self) -> DataFrame:
        return cut(self.pre.remaining)

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.scored_edges(self.remaining, OPEN)

    @cached_property
    def above(self) -> DataFrame:
        return cut(self.scored.where(F.col("score") > OPEN.floor).select("left_id", "right_id", "block", "score", "covered", "contradicted"))

    @cached_property
    def _solved(self) -> tuple[DataFrame, DataFrame]:
        chosen, nodes = assign.proposals(self.above, self.recs.sparkSession.createDataFrame([], "block string"), OPEN)
        return cut(chosen), cut(nodes)

    @property
    def chosen(self) -> DataFrame:
        return self._solved[0]

    @property
    def nodes(self) -> DataFrame:
        return self._solved[1]


def candidate_passes(spark, sf_dir):
    """Edges of three passes, one without a window, with the reasons of each."""
    rest = references.preprocess(_aliased(testbed.records(spark, sf_dir))).remaining
    made = generate(_aliased(rest), PASSES, OPEN)
    return made.edges.select("left_id", "right_id", F.array_join("reasons", ",").alias("reasons"))


def candidate_partitions(spark, sf_dir):
    rest = _aliased(references.preprocess(testbed.records(spark, sf_dir)).remaining)
    return generate(rest, PASSES, OPEN).blocks.select("partition_id", "reason", "n_left", "n_right")


def edge_codes(spark, sf_dir):
    """Contradictions under both contracts, and coverage failures, of the edges of all passes."""
    rest = _aliased(references.preprocess(testbed.records(spark, sf_dir)).remaining)
    pairs = generate(rest, PASSES, OPEN, carry=[*scoring.FIELDS, "alias"]).edges
    text = lambda c: F.array_join(c, ",")
    return pairs.select("left_id", "right_id", text(scoring.contradictions(OPEN)).alias("shared"), text(scoring.contradictions(replace(OPEN, reference_contract="SOURCE_LOCAL_OR_ALIAS"))).alias("local"), text(scoring.coverage_failures()).alias("coverage"))


def alias_comparison(spark, sf_dir):
    """The reference field of the reference pairs, compared by alias."""
    recs = _aliased(testbed.records(spark, sf_dir))
    pairs = scoring.with_records(references.preprocess(recs).pairs.select("left_id", "right_id"), recs)
    return compare.comparisons(pairs, Comparing(), "SOURCE_LOCAL_OR_ALIAS").where("field = 'reference'").select("left_id", "right_id", "status")


def field_differences(spark, sf_dir):
    recs = testbed.records(spark, sf_dir)
    return compare.differences(scoring.with_records(references.preprocess(recs).pairs.select("left_id", "right_id"), recs))


def time_labels(spark, sf_dir):
    """Differences in time of the reference pairs, as exact seconds and for people."""
    recs = testbed.records(spark, sf_dir)
    pairs = scoring.with_records(references.preprocess(recs).pairs.select("left_id", "right_id"), recs)
    apart = F.unix_micros("r_executed_at") - F.unix_micros("l_executed_at")
    return pairs.select("left_id", labels.seconds(apart).alias("seconds"), labels.duration(apart).alias("label"), labels.instant(F.col("l_executed_at")).alias("at"), labels.title(F.lit("GROSS_AMOUNT")).alias("field"))


def _cases(spark, sf_dir) -> cases.Cases:
    recs = testbed.records(spark, sf_dir)
    made = engine.reconcile(recs, OPEN, decisions=testbed.decisions(recs))
    return cases.materialized(made.outcomes, made.pairs, made.nodes, BOOK, SCOPE, POLICY_DIGEST, OPEN)


def case_rows(spark, sf_dir):
    """The cases of a run with decisions: pairs, records without a partner, ambiguities."""
    return _cases(spark, sf_dir).cases


def accepted_diagnostics(spark, sf_dir):
    """Good candidates of the records that are accepted as unmatched, and with whom those are paired now."""
    recs = testbed.records(spark, sf_dir)
    made = testbed.decisions(recs)
    pairs = engine.reconcile(recs, OPEN, decisions=made).pairs
    return diagnostics.accepted_unmatched(recs, made.accepted, pairs, OPEN, made.rejected)


def allocation_evidence(spark, sf_dir):
    run = _Run(spark, sf_dir)
    inside, policy = cases.by_component(run.remaining, run.nodes, OPEN)
    return cases.allocation(scoring.scored_edges(inside, policy), run.nodes, run.chosen).drop("component")


def _alone(run: _Run) -> DataFrame:
    taken = cases.ends(run.chosen.where("accepted")).select("id")
    return run.pre.remaining.select("id").join(taken, "id", "left_anti")


def link_options(spark, sf_dir):
    """Candidates of the records that stay unmatched, best first."""
    run = _Run(spark, sf_dir)
    return cases.link_options(run.scored, _alone(run))


def related_ids(spark, sf_dir):
    """For each remaining record, what it could have met or may not meet."""
    recs = testbed.records(spark, sf_dir)
    made = testbed.decisions(recs)
    rest = cut(references.preprocess(recs, made).remaining)
    no = cut(references._present(made.rejected, recs)[0])
    out = cases.related(candidates.edges(rest, OPEN, no), no, rest)
    return out.select("id", "n", F.array_join("related", ",").alias("related"))


def run_counters(spark, sf_dir):
    """What a run reports of itself, one row for each number."""
    run = _Run(spark, sf_dir)
    n = lambda name, df: df.agg(F.lit(name).alias("counter"), F.count("*").alias("n"))
    good = run.chosen.where("accepted")
    out = n("left_records", run.recs.where("rec_side = 'L'")).unionByName(n("right_records", run.recs.where("rec_side = 'R'")))
    for name, df in (("reference_pairs", run.pre.pairs), ("weighted_pairs", good), ("candidates", run.scored), ("components", run.nodes.select("component").distinct()), ("remaining", run.pre.remaining)):
        out = out.unionByName(n(name, df))
    return out


def greedy_pairs(spark, sf_dir):
    return evaluation.greedy(_Run(spark, sf_dir).above, OPEN)


def top_candidates(spark, sf_dir):
    """The 200 best candidates (a top-k report)."""
    return review.best(_Run(spark, sf_dir).scored).select("left_id", "right_id", "score")


def revision_page(spark, sf_dir):
    recs = testbed.records(spark, sf_dir).select("id", "instrument")
    return review.offset_page(recs, 3, "instrument", "id")


def decision_timeline(spark, sf_dir):
    recs = testbed.records(spark, sf_dir).where("rec_side = 'L'")
    k = F.col("k")
    times = F.explode(F.sequence(F.lit(1), (k % 3 + 1).cast("int"))).alias("revision")
    history = recs.select(F.col("id").alias("decision_id"), k, times).withColumn("action", F.when((k % 5 == 0) & (F.col("revision") == k % 3 + 1), "REVOKE").when(F.col("revision") == 1, "CREATE").otherwise("REAFFIRM"))
    return review.timeline(history).select("decision_id", "revision", "action", "previous")


def outcomes_by_passes(spark, sf_dir):
    """The engine with three passes, one of which has a window, that find together what the policy's own block finds."""
    recs = testbed.records(spark, sf_dir)
    return engine.reconcile(recs, OPEN, decisions=testbed.decisions(recs), passes=[Pass("near", window_seconds=3600), Pass("general"), Pass("nearest", window_seconds=60)]).outcomes


def decision_verdicts(spark, sf_dir):
    """Each 3rd key's decision links its L and the R three keys on, each 21st's is revoked. Each 5th key sends a command by its place among 20, each 25th one more."""
    recs = testbed.records(spark, sf_dir)
    keys = recs.where("rec_side = 'L'").select("k")
    k = F.col("k")
    name = lambda s, x=k: F.concat(F.lit(s), x.cast("string"))
    begun = keys.where(k % 3 == 0).select(name("D").alias("decision_id"), F.explode(F.sequence(F.lit(1), F.when(k % 21 == 0, 2).otherwise(1))).alias("revision"), name("L").alias("left_id"), name("R", k + 3).alias("right_id"))
    history = begun.select("decision_id", "revision", F.when(F.col("revision") == 2, "REVOKE").otherwise("LINK").alias("action"), F.lit("LINK").alias("authority"), "left_id", "right_id")
    action = F.when(k % 20 == 0, "REPLACE").when(k % 20 == 5, "LINK").when(k % 20 == 10, "REVOKE").otherwise("REAFFIRM")
    sent = keys.where(k % 5 == 0).select("k", name("C").alias("command"), action.alias("action")).unionByName(keys.where(k % 25 == 0).select("k", name("B").alias("command"), F.lit("LINK").alias("action")))
    has_ends, later = F.col("action").isin("LINK", "REPLACE"), F.col("action") != "LINK"
    sent = sent.select(
        "command", F.when(k % 35 == 0, 6).otherwise(7).alias("generation"), "action", F.when(has_ends, "LINK").alias("authority"), F.when(has_ends, name("L")).alias("left_id"), F.when(has_ends, name("R")).alias("right_id"),
        F.when(later, name("D")).alias("target_id"), F.when(later, 1).alias("target_revision"), F.when(later & (k % 40 == 0), F.array(F.concat(name("D", k - 3), F.lit("@1")))).alias("approved"),
    )
    out = commands.judged(sent, recs.select("id"), history, spark.createDataFrame([], "decision_id string"), 7)
    return out.select("command", "action", "left_id", "right_id", F.array_join("conflicts", ",").alias("conflicts"), "code")


def membership_problems(spark, sf_dir):
    """Each record's observation is of the next key for each 11th, unknown for each 13th; each 17th record is of another source, each 19th a member twice."""
    keys = testbed.records(spark, sf_dir).where("rec_side = 'L'").select("k")
    k = F.col("k")
    name = lambda s, x=k: F.concat(F.lit(s), x.cast("string"))
    members = keys.select(name("L").alias("logical_id"), F.explode(F.array_repeat(name("V"), F.when(k % 19 == 0, 2).otherwise(1))).alias("observation_id"))
    logicals = keys.select(name("L").alias("logical_id"), F.when(k % 17 == 0, "other").otherwise("ledger").alias("source"))
    observations = keys.where(k % 13 != 0).select(name("V").alias("observation_id"), name("L", F.when(k % 11 == 0, k + 1).otherwise(k)).alias("logical_id"))
    return memberships.problems(members, logicals, observations, "ledger")


def eligible_members(spark, sf_dir):
    return memberships.eligible(testbed.records(spark, sf_dir).withColumn("eligible", F.col("k") % 10 != 0)).select("id", "state")


def claim_conflicts(spark, sf_dir):
    """Each 5th key asks to link L and R; each 3rd key's decision claims its L and the next key's R, and replaces nothing but each 30th."""
    recs = testbed.records(spark, sf_dir).where("rec_side = 'L'").select("k")
    k = F.col("k")
    name = lambda s, x: F.concat(F.lit(s), x.cast("string"))
    asked = recs.where(k % 5 == 0).select(name("Q", k).alias("request"), F.when(k % 30 == 0, name("D", k)).alias("replaces"), F.explode(F.array(name("L", k), name("R", k))).alias("id"))
    claims = recs.where(k % 3 == 0).select(name("D", k).alias("decision_id"), F.lit(1).alias("revision"), F.explode(F.array(name("L", k), name("R", k + 1))).alias("id"))
    return cases.claim_conflicts(asked, claims).select("request", "decision_id", "revision", F.array_join("claimed", ",").alias("claimed"))


def component_digests(spark, sf_dir):
    run = _Run(spark, sf_dir)
    return digests.components(run.above, run.nodes, OPEN.floor).drop("component")


def fingerprints(spark, sf_dir):
    """Fingerprints of the left records as observations; the key alone has a provenance."""
    recs = testbed.records(spark, sf_dir).where("rec_side = 'L'")
    c = F.col
    values = {
        "business_reference": c("reference"), "currency": c("currency"), "executed_at_utc": exact.instant_of(c("executed_at")), "gross_amount": exact.text_of(c("gross_amount")), "instrument": c("instrument"),
        "quantity": exact.text_of(c("quantity")), "side": c("side"), "source_record_key": c("id"), "state": c("state"), "unit_price": F.lit("1.5"),
    }
    origin = F.array(F.struct(*[F.lit(v).alias(n) for n, v in (("canonical_field", "source_record_key"), ("source_column", "trade_id"), ("source_kind", "VALUE"), ("transformation", "trim"))]))
    return recs.select("id", digests.fingerprint(F.lit(POLICY_DIGEST), F.lit("UPSERT"), values, origin).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (
    candidate_passes, candidate_partitions, edge_codes, alias_comparison, field_differences, time_labels, case_rows, accepted_diagnostics, allocation_evidence, link_options, related_ids, run_counters,
    greedy_pairs, top_candidates, revision_page, decision_timeline, claim_conflicts, component_digests, fingerprints,
    outcomes_by_passes, decision_verdicts, membership_problems, eligible_members,
)}

_ALIASED = "(SELECT *, CASE WHEN k % 9 <> 0 THEN 'A' || CAST((k + CASE WHEN rec_side = 'R' AND k % 29 = 0 THEN 2 ELSE 0 END) // 2 AS VARCHAR) END AS alias FROM {})"
_REST = f"{_PRE}, rest AS (SELECT * FROM {_ALIASED.format('pre')} WHERE outcome = 'REMAINING'), lr AS (SELECT * FROM rest WHERE rec_side = 'L'), rr AS (SELECT * FROM rest WHERE rec_side = 'R')"
_WAYS = """ways AS (SELECT a.id AS left_id, b.id AS right_id, 'general@1' AS reason FROM lr a JOIN rr b ON a.instrument = b.instrument AND a.side = b.side AND a.currency = b.currency AND abs(epoch_us(a.executed_at) - epoch_us(b.executed_at)) <= 86400000000
 UNION ALL SELECT a.id, b.id, 'alias@1' FROM lr a JOIN rr b ON a.instrument = b.instrument AND a.alias = b.alias
 UNION ALL SELECT a.id, b.id, 'any-side@2' FROM lr a JOIN rr b ON a.instrument = b.instrument AND a.currency = b.currency AND abs(epoch_us(a.executed_at) - epoch_us(b.executed_at)) <= 3600000000)"""
_KEYS = {"general@1": ("instrument", "side", "currency"), "alias@1": ("instrument", "alias"), "any-side@2": ("instrument", "currency")}


def _key(parts: tuple[str, ...]) -> str:
    return "'[' || " + " || ',' || ".join(f"'\"' || {c} || '\"'" if c in parts else "'null'" for c in ("instrument", "side", "currency", "alias")) + " || ']'"


_PARTS = " UNION ALL ".join(f"SELECT '{r}' AS reason, {_key(p)} AS block, rec_side FROM rest WHERE alias IS NOT NULL OR {'alias' not in p}" for r, p in _KEYS.items())
_NO = "INTERVAL 24 HOUR AND NOT (a.k = b.k AND b.id[1] = 'R' AND a.k % 107 = 0))"
_RUN = f"{_PRE}, {_EDGES_OF}, {_SCORED}, {_CHOSEN}"
_DECIDED_RUN = f"{_DECIDED}, {_EDGES_OF.replace('INTERVAL 24 HOUR)', _NO)}, {_SCORED}, {_CHOSEN}, matched AS (SELECT left_id AS id, right_id AS other FROM chosen WHERE failing = '' UNION ALL SELECT right_id, left_id FROM chosen WHERE failing = '')"
_SEEN = """seen AS (SELECT id, min(CAST(contradicted AS INTEGER)) AS contradicted, max(score) AS top FROM (SELECT left_id AS id, contradicted, score FROM s UNION ALL SELECT right_id, contradicted, score FROM s) GROUP BY 1),
 final AS (SELECT pre.rec_side, pre.id, CASE WHEN pre.outcome <> 'REMAINING' THEN pre.outcome WHEN other IS NOT NULL THEN 'WEIGHTED_PAIR' WHEN top IS NULL AND pre.k % 107 = 0 AND pre.k % 11 <> 0 AND pre.id[1] <> 'Q' THEN 'PROHIBITED' WHEN top IS NULL THEN 'NO_CANDIDATE'
 WHEN contradicted = 1 THEN 'PROHIBITED' WHEN top <= 7000 THEN 'BELOW_ASSIGNMENT_FLOOR' ELSE 'AMBIGUOUS' END AS outcome, coalesce(pre.partner, other) AS partner FROM pre LEFT JOIN seen USING (id) LEFT JOIN matched USING (id))"""
_HEX = lambda x: f"lpad(printf('%x', strlen({x})), 16, '0') || hex(encode({x}))"


def _named(kind: str, *parts: str) -> str:
    held = ["'stable-case-key-v1'", f"'{kind}'", *parts]
    return f"'{kind.lower()}:' || sha256({' || '.join(_EIGHT(p) for p in held)})"


_MEMBERS = "stars AS (SELECT DISTINCT center, id, rec_side FROM (SELECT center, left_id AS id, 'L' AS rec_side FROM star UNION ALL SELECT center, right_id, 'R' FROM star))"
_FIXED = " || ".join(_HEX(f"'{x}'") for x in ("stable-case-key-v1", "AMBIGUITY", "book", BOOK, "scope", SCOPE, "policy", POLICY_DIGEST))


def _listed(name: str, side: str) -> str:
    n = f"CAST(count(*) FILTER (rec_side = '{side}') AS VARCHAR)"
    each = _HEX(f"'{name}-member'") + " || " + _HEX("id")
    return f"{_HEX(chr(39) + name + '-count' + chr(39))} || {_HEX(n)} || string_agg({each}, '' ORDER BY id) FILTER (rec_side = '{side}')"


_CODES = "concat_ws(',', CASE WHEN lc <> rc THEN 'CURRENCY_MISMATCH' END, CASE WHEN li <> ri THEN 'INSTRUMENT_MISMATCH' END, CASE WHEN {0} <> {1} THEN '{2}' END, CASE WHEN ls <> rs THEN 'SIDE_MISMATCH' END)"
_NUMBER = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || (abs({0}) // 100) || CASE WHEN {0} % 100 = 0 THEN '' WHEN {0} % 10 = 0 THEN '.' || ((abs({0}) % 100) // 10) ELSE '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0') END"

_AMOUNT = "(cents // 100) || CASE WHEN cents % 100 = 0 THEN '' WHEN cents % 10 = 0 THEN '.' || ((cents % 100) // 10) ELSE '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END"
_FIELDS = {
    "business_reference": ("TEXT", "reference"), "currency": ("TEXT", "currency"), "executed_at_utc": ("DATETIME", "strftime(executed_at, '%Y-%m-%dT%H:%M:%S.%fZ')"), "gross_amount": ("DECIMAL", _AMOUNT), "instrument": ("TEXT", "instrument"),
    "quantity": ("DECIMAL", "quantity"), "side": ("ENUM", "side"), "source_record_key": ("TEXT", "id"), "state": ("ENUM", "state"), "unit_price": ("DECIMAL", "'1.5'"),
}
_OBSERVED = " || ',' || ".join(f"""'{{"name":"{n}","tag":"{t}","value":"' || {v} || '"}}'""" for n, (t, v) in _FIELDS.items())

ORACLE_SQL = {
    "component_digests": f"""{_RUN}, g AS (SELECT center, to_json(list_sort(list(DISTINCT left_id))) AS ls, to_json(list_sort(list(DISTINCT right_id))) AS rs, to_json(list({{'complete': true, 'left_id': left_id, 'right_id': right_id, 'score_bp': score}} ORDER BY left_id, right_id)) AS es FROM star GROUP BY 1),
 n AS (SELECT *, 'component-' || sha256('{{"left":' || ls || ',"right":' || rs || '}}')[1:16] AS component_id FROM g) SELECT component_id, sha256('{{"assignment_floor_bp":7000,"component_id":"' || component_id || '","edges":' || es || '}}') AS graph_digest FROM n""",
    "fingerprints": f"""{_B} SELECT id, sha256('{{"kind":"observation","payload":{{"contract_digest":"{POLICY_DIGEST}","fields":[' || {_OBSERVED} || '],"operation":"UPSERT","provenance":[{{"canonical_field":"source_record_key","source_column":"trade_id","source_kind":"VALUE","transformation":"trim"}}]}},"version":"reconciliation-sha256-v1"}}') AS fingerprint FROM l""",
    "candidate_passes": f"{_REST}, {_WAYS} SELECT left_id, right_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM ways GROUP BY 1, 2",
    "candidate_partitions": f"""{_REST}, p AS ({_PARTS}) SELECT 'partition-' || sha256('{{"blocking_pass":"' || reason || '","key":' || block || '}}')[1:16] AS partition_id, reason,
 count(*) FILTER (rec_side = 'L') AS n_left, count(*) FILTER (rec_side = 'R') AS n_right FROM p GROUP BY reason, block HAVING n_left > 0 AND n_right > 0""",
    "edge_codes": f"""{_REST}, {_WAYS}, j AS (SELECT DISTINCT w.left_id, w.right_id, a.instrument AS li, b.instrument AS ri, a.side AS ls, b.side AS rs, a.currency AS lc, b.currency AS rc, a.reference AS lref, b.reference AS rref, a.alias AS lal, b.alias AS ral, a.quantity IS NULL OR b.quantity IS NULL AS noq
 FROM ways w JOIN lr a ON a.id = w.left_id JOIN rr b ON b.id = w.right_id)
 SELECT left_id, right_id, {_CODES.format("lref", "rref", "SHARED_REFERENCE_MISMATCH")} AS shared, {_CODES.format("lal", "ral", "SHARED_ALIAS_MISMATCH")} AS local, CASE WHEN noq THEN 'MISSING_QUANTITY' ELSE '' END AS coverage FROM j""",
    "alias_comparison": f"{_PRE}, al AS {_ALIASED.format('recs')} SELECT left_id, right_id, CASE WHEN x.alias IS NULL OR y.alias IS NULL THEN 'MISSING' WHEN x.alias = y.alias THEN 'EXACT' ELSE 'DISCREPANT' END AS status FROM pairs JOIN al x ON x.id = left_id JOIN al y ON y.id = right_id",
    "field_differences": f"""{_PRE}, {_BOTH} SELECT left_id, right_id, 'quantity' AS field, CAST(rq - lq AS VARCHAR) AS difference, '0.00000001' AS tolerance FROM joined WHERE lq IS NOT NULL AND rq IS NOT NULL
 UNION ALL SELECT left_id, right_id, 'unit_price', {_NUMBER.format("(rp - lp)")}, '0.01' FROM joined WHERE lp IS NOT NULL AND rp IS NOT NULL AND lc = rc
 UNION ALL SELECT left_id, right_id, 'gross_amount', {_NUMBER.format("(ra - la)")}, '0.05' FROM joined WHERE lc = rc""",
    "time_labels": f"""{_PRE}, {_BOTH}, t AS (SELECT left_id, lt, epoch_us(rt) - epoch_us(lt) AS us FROM joined) SELECT left_id, CAST(us // 1000000 AS VARCHAR) AS seconds,
 CASE WHEN us = 0 THEN '0 s' WHEN us % 60000000 = 0 THEN (us // 60000000) || ' min' ELSE (us // 1000000) || ' s' END AS label, strftime(lt, '%Y-%m-%d %H:%M:%S UTC') AS at, 'Gross Amount' AS field FROM t""",
    "case_rows": f"""{_DECIDED_RUN}, {_SEEN}, {_MEMBERS}, unsure AS (SELECT DISTINCT center FROM stars JOIN final USING (id) WHERE outcome = 'AMBIGUOUS')
 SELECT 'PAIR' AS kind, {_named("PAIR", "'book'", f"'{BOOK}'", "'left'", "id", "'right'", "partner")} AS case_key, CAST(2 AS BIGINT) AS n_members, outcome AS detail FROM final WHERE rec_side = 'L' AND partner IS NOT NULL
 UNION ALL SELECT 'UNPAIRED', {_named("UNPAIRED", "'book'", f"'{BOOK}'", "'side'", "CASE rec_side WHEN 'L' THEN 'LEFT' ELSE 'RIGHT' END", "'record'", "id")}, 1, outcome FROM final WHERE partner IS NULL
 UNION ALL SELECT 'AMBIGUITY', 'ambiguity:' || sha256(unhex({_FIXED} || {_listed("left", "L")} || {_listed("right", "R")})), count(*), 'AMBIGUITY' FROM stars SEMI JOIN unsure USING (center) GROUP BY center""",
    "accepted_diagnostics": f"""{_DECIDED_RUN}, now AS (SELECT id, partner FROM pre WHERE partner IS NOT NULL UNION ALL SELECT * FROM matched),
 {_EDGES_OF.replace("rest AS", "rest2 AS").replace("SELECT * FROM pre WHERE outcome = 'REMAINING'", "SELECT * FROM recs WHERE state <> 'CANCELLED'").replace(", e AS (", ", e2 AS (").replace("FROM rest a JOIN rest b", "FROM rest2 a JOIN rest2 b").replace("INTERVAL 24 HOUR)", "INTERVAL 24 HOUR AND a.k % 103 = 0 AND a.k % 101 <> 0 AND NOT (a.k = b.k AND b.id[1] = 'R' AND a.k % 107 = 0))")},
 {_SCORED.replace("f AS (SELECT", "f2 AS (SELECT").replace("FROM e)", "FROM e2)").replace(", s AS (SELECT", ", s2 AS (SELECT").replace("FROM f)", "FROM f2)")}
 SELECT 'ACCEPTED_UNMATCHED_CANDIDATE' AS kind, left_id AS record_id, right_id AS candidate_id, partner AS current_partner, score, true AS complete FROM s2 LEFT JOIN now ON now.id = right_id WHERE score >= 9000 AND covered AND NOT contradicted""",
    "allocation_evidence": f"""{_RUN}, {_MEMBERS} SELECT s.left_id, s.right_id, s.score, c.left_id IS NOT NULL AS selected, coalesce(c.failing = '', false) AS accepted, c.gap, c.failing
 FROM s JOIN stars x ON x.id = s.left_id JOIN stars y ON y.id = s.right_id AND x.center = y.center LEFT JOIN chosen c ON c.left_id = s.left_id AND c.right_id = s.right_id""",
    "link_options": f"""{_RUN}, alone AS (SELECT id FROM pre WHERE outcome = 'REMAINING' AND id NOT IN (SELECT left_id FROM chosen WHERE failing = '' UNION ALL SELECT right_id FROM chosen WHERE failing = '')),
 m AS (SELECT left_id AS id, right_id AS other, score FROM s UNION ALL SELECT right_id, left_id, score FROM s) SELECT id, other, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS INTEGER) AS place FROM m SEMI JOIN alone USING (id)""",
    "related_ids": f"""{_DECIDED}, {_EDGES_OF.replace("INTERVAL 24 HOUR)", _NO)}, no AS (SELECT l.id AS left_id, 'R' || l.k AS right_id FROM l WHERE k % 107 = 0 AND k % 11 <> 0),
 m AS (SELECT left_id AS id, right_id AS other FROM e UNION SELECT right_id, left_id FROM e UNION SELECT left_id, right_id FROM no UNION SELECT right_id, left_id FROM no)
 SELECT rest.id, count(other) AS n, coalesce(string_agg(other, ',' ORDER BY other), '') AS related FROM rest LEFT JOIN m USING (id) GROUP BY 1""",
    "run_counters": f"""{_RUN} SELECT 'left_records' AS counter, count(*) AS n FROM l UNION ALL SELECT 'right_records', count(*) FROM r UNION ALL SELECT 'reference_pairs', count(*) FROM pairs UNION ALL SELECT 'weighted_pairs', count(*) FROM chosen WHERE failing = ''
 UNION ALL SELECT 'candidates', count(*) FROM s UNION ALL SELECT 'components', count(DISTINCT center) FROM star UNION ALL SELECT 'remaining', count(*) FROM rest""",
    "greedy_pairs": f"{_RUN}, g AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY score DESC, left_id, right_id) AS nth FROM star WHERE score >= 9000 AND covered AND NOT contradicted) SELECT left_id, right_id, score FROM g WHERE nth = 1",
    "top_candidates": f"{_RUN} SELECT left_id, right_id, score FROM s ORDER BY score DESC, left_id, right_id LIMIT 200",
    "revision_page": f"{_B} SELECT id, instrument FROM recs ORDER BY instrument, id LIMIT 50 OFFSET 100",
    "decision_timeline": f"""{_B}, h AS (SELECT id AS decision_id, k, CAST(unnest(range(1, CAST(k % 3 + 2 AS BIGINT))) AS INTEGER) AS revision FROM l), x AS (SELECT decision_id, revision, CASE WHEN k % 5 = 0 AND revision = k % 3 + 1 THEN 'REVOKE' WHEN revision = 1 THEN 'CREATE' ELSE 'REAFFIRM' END AS action FROM h)
 SELECT *, lag(action) OVER (PARTITION BY decision_id ORDER BY revision) AS previous FROM x""",
    "outcomes_by_passes": queries_sql["outcomes"],
    "decision_verdicts": f"""{_B}, act AS (SELECT k FROM l WHERE k % 3 = 0 AND k % 21 <> 0),
 cmd AS (SELECT 'C' || k AS command, k, CASE k % 20 WHEN 0 THEN 'REPLACE' WHEN 5 THEN 'LINK' WHEN 10 THEN 'REVOKE' ELSE 'REAFFIRM' END AS action FROM l WHERE k % 5 = 0 UNION ALL SELECT 'B' || k, k, 'LINK' FROM l WHERE k % 25 = 0),
 c AS (SELECT cmd.*, action IN ('LINK', 'REPLACE') AS fresh, own.k IS NOT NULL AS held, before.k AS kb, rl.id IS NOT NULL AS has_r, r3.id IS NOT NULL AS has_r3 FROM cmd LEFT JOIN act own ON own.k = cmd.k LEFT JOIN act before ON before.k = cmd.k - 3
  LEFT JOIN recs rl ON rl.id = 'R' || cmd.k LEFT JOIN recs r3 ON r3.id = 'R' || (cmd.k + 3)),
 d AS (SELECT *, CASE WHEN fresh THEN concat_ws(',', CASE WHEN kb IS NOT NULL THEN 'D' || kb || '@1' END, CASE WHEN action = 'LINK' AND held THEN 'D' || k || '@1' END) ELSE '' END AS raw FROM c),
 x AS (SELECT *, array_to_string(list_sort([y FOR y IN string_split(raw, ',') IF y <> '']), ',') AS conflicts FROM d),
 v AS (SELECT *, CASE WHEN k % 35 = 0 THEN 'STALE_GENERATION' WHEN action <> 'LINK' AND NOT held THEN 'STALE_REVISION' WHEN fresh AND NOT has_r OR action = 'REAFFIRM' AND NOT has_r3 THEN 'UNKNOWN_RECORD'
  WHEN action = 'LINK' AND conflicts <> '' THEN 'ENDPOINT_CLAIMED' WHEN action = 'REPLACE' AND conflicts <> CASE WHEN k % 40 = 0 THEN 'D' || (k - 3) || '@1' ELSE '' END THEN 'CONFLICT_SET_CHANGED' END AS code FROM x),
 t AS (SELECT command, unnest(CASE action WHEN 'LINK' THEN ['L' || k, 'R' || k] WHEN 'REPLACE' THEN ['L' || k, 'R' || k, 'D' || k, 'D' || kb] ELSE ['D' || k] END) AS thing FROM v WHERE code IS NULL),
 f AS (SELECT thing, min(command) AS first FROM t WHERE thing IS NOT NULL GROUP BY 1), lost AS (SELECT DISTINCT command FROM t JOIN f USING (thing) WHERE command <> first)
 SELECT v.command, action, CASE WHEN fresh OR held THEN 'L' || k END AS left_id, CASE WHEN fresh THEN 'R' || k WHEN held THEN 'R' || (k + 3) END AS right_id, conflicts, coalesce(code, CASE WHEN lost.command IS NOT NULL THEN 'CONTENDED' END) AS code FROM v LEFT JOIN lost ON lost.command = v.command""",
    "membership_problems": f"""{_B} SELECT CASE WHEN k % 13 = 0 THEN 'UNKNOWN_OBSERVATION' WHEN k % 11 = 0 THEN 'OBSERVATION_OF_ANOTHER_RECORD' ELSE 'RECORD_OF_ANOTHER_SOURCE' END AS what, id AS logical_id, 'V' || k AS observation_id
 FROM (SELECT *, unnest(range(CAST(CASE WHEN k % 19 = 0 THEN 2 ELSE 1 END AS BIGINT))) AS i FROM l) WHERE k % 13 = 0 OR k % 11 = 0 OR k % 17 = 0 UNION ALL SELECT 'MEMBER_TWICE', id, 'V' || k FROM l WHERE k % 19 = 0""",
    "eligible_members": f"{_B} SELECT id, state FROM recs WHERE state = 'SETTLED' AND k % 10 <> 0",
    "claim_conflicts": f"""{_B}, q AS (SELECT k, unnest(['L' || k, 'R' || k]) AS id FROM l WHERE k % 5 = 0), d AS (SELECT k, unnest(['L' || k, 'R' || (k + 1)]) AS id FROM l WHERE k % 3 = 0), h AS (SELECT DISTINCT q.k AS qk, d.k AS dk FROM q JOIN d USING (id) WHERE NOT (q.k % 30 = 0 AND q.k = d.k))
 SELECT 'Q' || qk AS request, 'D' || dk AS decision_id, 1 AS revision, 'L' || dk || ',R' || (dk + 1) AS claimed FROM h""",
}
