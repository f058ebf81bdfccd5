"""Queries of candidate generation under caps, and the same in DuckDB's SQL: each pass one after the other, by windows over its edges."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import engine, references
from ..operators.passes import Generated, generate
from ..operators.policy import Matching
from . import testbed
from .evidence import _REST, PASSES, _aliased
from .queries import OPEN

#: Caps that the test tables hit, in all passes, and a run's cap that some block of a later pass hits.
FEW, SHORT = replace(OPEN, record_edges=4, run_edges=250_000), replace(OPEN, record_edges=3, run_edges=2_000)


def _generated(spark: SparkSession, sf_dir: str, policy: Matching) -> Generated:
    rest = references.preprocess(_aliased(testbed.records(spark, sf_dir))).remaining
    return generate(_aliased(rest), PASSES, policy)


def _states(made: Generated) -> DataFrame:
    return made.blocks.groupBy("reason", F.coalesce("limit", F.lit("COMPLETE")).alias("state")).agg(F.count("*").alias("n"))


def capped_passes(spark, sf_dir):
    """Blocks by reason and limit, where a record's cap is hit and incompleteness spreads."""
    return _states(_generated(spark, sf_dir, FEW))


def run_capped_passes(spark, sf_dir):
    """The same where the run's cap is hit too."""
    return _states(_generated(spark, sf_dir, SHORT))


def capped_edges(spark, sf_dir):
    """The edges that three passes leave under both caps."""
    made = _generated(spark, sf_dir, SHORT)
    return made.edges.select("left_id", "right_id", F.array_join("reasons", ",").alias("reasons"))


def dense_block(spark, sf_dir):
    """All records of both sides alike and in one block: the engine keeps a record's cap of edges and abstains on everything."""
    recs = testbed.records(spark, sf_dir).withColumns({
        "instrument": F.lit("ONE"), "side": F.lit("BUY"), "currency": F.lit("USD"), "reference": F.lit(None).cast("string"), "executed_at": F.lit("2026-09-07 12:00:00").cast("timestamp"),
        "quantity": F.lit(2).cast("decimal(28,12)"), "unit_price": F.lit(100).cast("decimal(28,12)"), "gross_amount": F.lit(200).cast("decimal(28,12)"),
    })
    made = engine.reconcile(recs, Matching())
    return made.outcomes.groupBy(F.col("outcome").alias("what")).agg(F.count("*").alias("n")).unionByName(made.scored.agg(F.count("*").alias("n")).withColumn("what", F.lit("EDGES")))


QUERIES = {f.__name__: f for f in (capped_passes, run_capped_passes, capped_edges, dense_block)}


def _key_sql(block_on: tuple[str, ...], record: str) -> str:
    parts = [f"""'"' || {record}.{c} || '"'""" if c in block_on else "'null'" for c in ("instrument", "side", "currency", "alias")]
    return " || ',' || ".join(parts)


def _pass_sql(k: int, p, policy: Matching) -> str:
    """Tables of pass ``k``: its records' blocks (m), edges (w) in order (g), stops (s, u), the run's cap (x), kept edges (k), edges so far (h) and blocks (b)."""
    same = " AND ".join(f"a.{c} = b.{c}" for c in p.block_on)
    near = "" if p.window_seconds is None else f" AND abs(epoch_us(a.executed_at) - epoch_us(b.executed_at)) <= {p.window_seconds * 1_000_000}"
    at = lambda r: "0" if p.window_seconds is None else f"epoch_us({r}.executed_at)"
    usable = " AND ".join(f"{c} IS NOT NULL" for c in (*p.block_on, *(() if p.window_seconds is None else ("executed_at",))))
    line, room, over = "lat, w.left_id, rat, w.right_id ROWS UNBOUNDED PRECEDING", f"({policy.run_edges} - (SELECT count(*) FROM h{k - 1}))", f"new AND greatest(nl, nr) > {policy.record_edges}"
    earlier = " OR ".join(["false", *(f"EXISTS (SELECT 1 FROM x{i} WHERE hit IS NOT NULL)" for i in range(1, k))])
    return f"""
m{k} AS (SELECT '{p.reason}' AS reason, {_key_sql(p.block_on, "rest")} AS block, id, rec_side FROM rest WHERE {usable}),
w{k} AS (SELECT a.id AS left_id, b.id AS right_id, {_key_sql(p.block_on, "a")} AS block, {at("a")} AS lat, {at("b")} AS rat, h.left_id IS NULL AS new
  FROM lr a JOIN rr b ON {same}{near} LEFT JOIN h{k - 1} h ON h.left_id = a.id AND h.right_id = b.id WHERE NOT ({earlier})),
g{k} AS MATERIALIZED (SELECT w.*, coalesce(dl.n, 0) + sum(new::INT) OVER (PARTITION BY block, w.left_id ORDER BY {line}) AS nl, coalesce(dr.n, 0) + sum(new::INT) OVER (PARTITION BY block, w.right_id ORDER BY {line}) AS nr,
  sum(new::INT) OVER (PARTITION BY block ORDER BY {line}) AS nth FROM w{k} w LEFT JOIN (SELECT left_id, count(*) AS n FROM h{k - 1} GROUP BY 1) dl ON dl.left_id = w.left_id LEFT JOIN (SELECT right_id, count(*) AS n FROM h{k - 1} GROUP BY 1) dr ON dr.right_id = w.right_id),
s{k} AS (SELECT block, coalesce(min(nth) FILTER (WHERE {over}) - 1, max(nth)) AS keep, CASE WHEN bool_or({over}) THEN 'PER_RECORD_LIMIT' END AS lim FROM g{k} GROUP BY block),
u{k} AS MATERIALIZED (SELECT *, sum(keep) OVER (ORDER BY block ROWS UNBOUNDED PRECEDING) AS upto FROM s{k}),
x{k} AS MATERIALIZED (SELECT min(block) AS hit FROM u{k} WHERE upto > {room}),
k{k} AS MATERIALIZED (SELECT left_id, right_id, new FROM g{k} JOIN u{k} USING (block), x{k} WHERE (hit IS NULL OR block <= hit) AND nth <= CASE WHEN block = hit THEN {room} - upto + keep ELSE keep END),
h{k} AS MATERIALIZED (SELECT left_id, right_id FROM h{k - 1} UNION ALL SELECT left_id, right_id FROM k{k} WHERE new),
b{k} AS (SELECT reason, block, CASE WHEN {earlier} OR block >= hit THEN 'RUN_EDGE_LIMIT' ELSE lim END AS lim
  FROM (SELECT reason, block FROM m{k} GROUP BY 1, 2 HAVING count(DISTINCT rec_side) = 2) q LEFT JOIN s{k} USING (block), x{k})"""


def _passes_sql(policy: Matching, last: str) -> str:
    n = range(1, len(PASSES) + 1)
    every = lambda what: " UNION ALL ".join(what.format(k=k, reason=p.reason) for k, p in zip(n, PASSES))
    return f"""WITH RECURSIVE {_REST.removeprefix("WITH ")}, h0 AS (SELECT NULL::VARCHAR AS left_id, NULL::VARCHAR AS right_id WHERE false), {",".join(_pass_sql(k, p, policy) for k, p in zip(n, PASSES))},
bs AS MATERIALIZED ({every("SELECT * FROM b{k}")}),
ms AS MATERIALIZED (SELECT m.reason, m.block, m.id FROM ({every("SELECT * FROM m{k}")}) m JOIN bs ON bs.reason = m.reason AND bs.block = m.block),
reached(reason, block) AS (SELECT reason, block FROM bs WHERE lim IS NOT NULL UNION SELECT o.reason, o.block FROM reached t JOIN ms i ON i.reason = t.reason AND i.block = t.block JOIN ms o ON o.id = i.id),
ks AS ({every("SELECT left_id, right_id, '{reason}' AS reason FROM k{k}")})
{last}"""


_STATES = "SELECT bs.reason, coalesce(lim, CASE WHEN t.block IS NOT NULL THEN 'CONNECTED_TO_INCOMPLETE_PARTITION' ELSE 'COMPLETE' END) AS state, count(*) AS n FROM bs LEFT JOIN reached t ON t.reason = bs.reason AND t.block = bs.block GROUP BY 1, 2"
_EDGES = "SELECT left_id, right_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM ks GROUP BY 1, 2"

ORACLE_SQL = {
    "capped_passes": _passes_sql(FEW, _STATES),
    "run_capped_passes": _passes_sql(SHORT, _STATES),
    "capped_edges": _passes_sql(SHORT, _EDGES),
    "dense_block": f"""WITH {testbed.SQL}, n AS (SELECT count(*) FILTER (WHERE rec_side = 'L') AS l, count(*) FILTER (WHERE rec_side = 'R') AS r FROM recs WHERE state <> 'CANCELLED')
SELECT 'CANCELLED' AS what, count(*) AS n FROM recs WHERE state = 'CANCELLED' UNION ALL SELECT CASE WHEN greatest(l, r) > 200 THEN 'COMPUTATION_LIMITED' ELSE 'AMBIGUOUS' END, l + r FROM n
UNION ALL SELECT 'EDGES', CASE WHEN r > 200 THEN 200 ELSE l * r END FROM n""",
}
