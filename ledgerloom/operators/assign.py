"""Weighted one-to-one assignment inside each component, with the choice to leave records unmatched, and its gates.

Components are bounded by the policy (100 nodes, 2500 edges); larger ones, and those of incomplete blocks, never come to a
task: they are limited and select nothing. A selected edge's gap is the loss of the best assignment without it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, cut, forgotten
from .policy import Matching

#: Edges that one task solves at a time, about.
EDGES_A_BATCH = 20_000
Solver = Callable[[np.ndarray], np.ndarray]


class Paths:
    """Shortest augmenting paths with potentials: rows are added one at a time, each at the least total cost."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        n, m = costs.shape
        self.row_of, self.column_of = np.full(m, -1), np.full(n, -1)
        self.u, self.v = np.zeros(n, np.int64), np.zeros(m, np.int64)

    def add(self, i: int) -> None:
        far = np.iinfo(np.int64).max
        base, via = self.costs[i] - self.u[i] - self.v, np.full(len(self.v), i)
        open_ = base.copy()  # distances of columns that are not settled
        path = []
        while True:
            j = int(open_.argmin())
            path.append(j)
            k = self.row_of[j]
            if k < 0:
                break
            open_[j] = far
            further = base[j] + self.costs[k] - self.u[k] - self.v
            better = (open_ != far) & (further < base)
            base[better], open_[better], via[better] = further[better], further[better], k
        end = base[path[-1]]
        self.u[i] += end
        for j in path[:-1]:
            self.u[self.row_of[j]] += end - base[j]
            self.v[j] -= end - base[j]
        j = path[-1]
        while True:
            k = via[j]
            before = self.column_of[k]
            self.row_of[j], self.column_of[k] = k, j
            if k == i:
                return
            j = before

    def loss(self, i: int, j: int) -> int:
        """What the least total cost grows by if row i may not take its column j, and every column is taken: the shortest
        way by which row i takes another column and some row takes j."""
        far = np.iinfo(np.int64).max
        base = self.costs[i] - self.u[i] - self.v
        base[j] = far // 4
        open_ = base.copy()
        while (c := int(open_.argmin())) != j:
            k = self.row_of[c]
            further = base[c] + self.costs[k] - self.u[k] - self.v
            open_[c] = far
            better = (open_ != far) & (further < base)
            base[better], open_[better] = further[better], further[better]
        return int(base[j])


def minimize(costs: np.ndarray) -> np.ndarray:
    """The column of each row at the least total cost (rows <= columns)."""
    paths = Paths(costs)
    for i in range(len(costs)):
        paths.add(i)
    return paths.column_of


def _costs(gain: np.ndarray) -> np.ndarray:
    """Columns for the right records, then one for each row to stay unmatched at no cost. Entries of 0 are no edges."""
    n, m = gain.shape
    costs = np.zeros((n, m + n), np.int64)
    costs[:, :m] = np.where(gain > 0, -gain, n * 10_001 + 1)
    return costs


def _total(gain: np.ndarray, columns: np.ndarray) -> int:
    rows = np.flatnonzero(columns < gain.shape[1])
    return int(gain[rows, columns[rows]].sum())


def checked(picked: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """What a solver of one's own picked: one column in range for each row, none twice; else an error."""
    picked = np.asarray(picked)
    if picked.shape != (rows,) or picked.dtype.kind not in "iu":
        raise ValueError("a solver gives the number of one column for each row")
    if len(picked) and (picked.min() < 0 or picked.max() >= columns):
        raise ValueError("a solver picked a column out of range")
    if len(np.unique(picked)) != rows:
        raise ValueError("a solver picked a column twice")
    return picked


def solve(lefts: list, rights: list, scores: list[int], floor: int, solver: Solver | None = None) -> tuple[int, list[tuple]]:
    """Objective and selected edges (left, right, objective without the edge). A ``solver`` of one's own is run anew for each."""
    rows, columns = sorted(set(lefts)), sorted(set(rights))
    at, to = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(columns)}
    gain = np.zeros((len(rows), len(columns)), np.int64)
    for l, r, s in zip(lefts, rights, scores):
        gain[at[l], to[r]] = max(0, s - floor)
    costs = _costs(gain)
    if solver is None:  # a row that costs nothing for each column that no record takes
        paths = Paths(np.concatenate([costs, np.zeros((len(columns), costs.shape[1]), np.int64)]))
        for i in range(costs.shape[1]):
            paths.add(i)
        picked = paths.column_of[: len(rows)]
    else:
        picked = checked(solver(costs), *costs.shape)
    total, out = _total(gain, picked), []
    for i, j in enumerate(picked.tolist()):
        if j >= len(columns) or not gain[i, j]:
            continue
        if solver is None:
            rest = total - paths.loss(i, j)
        else:
            less = gain.copy()
            less[i, j] = 0
            rest = _total(less, checked(solver(_costs(less)), *costs.shape))
        out.append((rows[i], columns[j], rest))
    return total, out


def _named(edges: DataFrame) -> DataFrame:
    """node, component of all nodes. Edges whose ends have no other edge are components by themselves; only the rest takes rounds."""
    ends = lambda end: edges.groupBy(end).agg(F.count("*").alias(f"n_{end}"))
    edges = cut(edges.join(ends("left_id"), "left_id").join(ends("right_id"), "right_id"))
    lone = (F.col("n_left_id") == 1) & (F.col("n_right_id") == 1)
    alone = edges.where(lone).select(F.explode(F.array("left_id", "right_id")).alias("node"), F.least("left_id", "right_id").alias("component"))
    found = components(edges.where(~lone).select("left_id", "right_id"))
    out = cut(found.unionByName(alone))
    forgotten(edges, found)
    return out


def proposals(scored: DataFrame, incomplete: DataFrame, policy: Matching, solver: Solver | None = None) -> tuple[DataFrame, DataFrame]:
    """Selected edges with objective, gap and verdict; and node, component, limited of every node above the floor.

    ``scored``: left_id, right_id, block, score, covered, contradicted."""
    above = cut(scored.where(F.col("score") > policy.floor).select("left_id", "right_id", "block", "score", "covered", "contradicted"))
    named = _named(above.select("left_id", "right_id"))
    held = above.join(named.withColumnRenamed("node", "left_id"), "left_id")
    bad = incomplete.select(F.col("block").alias("bad_block")).distinct()
    held = held.join(bad, F.col("block") == F.col("bad_block"), "left")
    nodes = named.groupBy("component").agg(F.count("*").alias("n_nodes"))
    sizes = held.groupBy("component").agg(F.count("*").alias("n_edges"), F.max(F.col("bad_block").isNotNull()).alias("incomplete")).join(nodes, "component")
    reason = F.when(F.col("incomplete"), "INCOMPLETE").when(F.col("n_nodes") > policy.nodes, "NODES").when(F.col("n_edges") > policy.edges, "EDGES")
    sizes = sizes.withColumn("limited", reason)
    floor = policy.floor

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, own in part.groupby("component", sort=False):
            total, picked = solve(own["left_id"].tolist(), own["right_id"].tolist(), own["score"].tolist(), floor, solver)
            out += [(name, l, r, total, total - rest) for l, r, rest in picked]
        return pd.DataFrame(out, columns=["component", "left_id", "right_id", "objective", "gap"])

    free = cut(held.join(sizes.where("limited is null").select("component", "n_edges"), "component").select("component", "left_id", "right_id", "score", "n_edges"))
    # one edge alone is selected, and without it nothing is; other components go to tasks many at a time
    gain = (F.col("score") - F.lit(floor)).cast("bigint")
    alone = free.where("n_edges = 1").select("component", "left_id", "right_id", gain.alias("objective"), gain.alias("gap"))
    several = free.where("n_edges > 1")
    batches = max(1, -(-several.count() // EDGES_A_BATCH))
    batched = several.withColumn("batch", F.pmod(F.xxhash64("component"), F.lit(batches)))
    solved = batched.groupBy("batch").applyInPandas(run, "component string, left_id string, right_id string, objective long, gap long")
    chosen = alone.unionByName(solved)
    chosen = chosen.join(above.select("left_id", "right_id", "score", "covered", "contradicted"), ["left_id", "right_id"])
    failing = F.array_compact(F.array(
        F.when(F.col("score") < policy.threshold, F.lit("SCORE")), F.when(~F.col("covered"), F.lit("COVERAGE")), F.when(F.col("contradicted"), F.lit("CONTRADICTION")), F.when(F.col("gap") < policy.gap, F.lit("GAP"))
    ))
    chosen = chosen.withColumn("failing", F.concat_ws(",", failing)).withColumn("accepted", F.col("failing") == "")
    return chosen, named.join(sizes.select("component", "limited"), "component")
