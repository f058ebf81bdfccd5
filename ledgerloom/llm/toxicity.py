"""Operator 6: toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words, hashed. Their score is
``w0 + sum w_i + sum_{i<j} <v_i, v_j>``: the vectors let two terms together weigh more or less than each alone (an
insult beside the mention of a group). The linear part learns by follow-the-regularised-leader updates,
which leave most terms at exactly zero; only terms with a weight have a vector, learnt by AdaGrad. So the
pair sum runs over the few terms that carry evidence, by the usual identity in linear time.

Training: see ``hashed``. It takes at most ``most_rows`` labelled rows; every document is scored whole.

Defined results: null and empty texts have no terms and get the constant's score; without any label to learn
from, all scores are 0.5; repeated rows are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashed, textkit


@dataclass(frozen=True)
class Machine:
    """Parameters."""

    bits: int = 18
    factors: int = 4
    most_rows: int = 24_000
    shards: int = 4
    rounds: int = 4
    rate: float = 1.0
    vector_rate: float = 0.05
    vector_l2: float = 1e-4
    l1: float = 4.0
    least: float = 0.5
    seed: int = 6


def _terms(bits: int):
    def terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        starts, _, hashes = textkit.words(data, offsets, space=textkit.NOT_WORD)
        first = textkit.row_slices(starts, offsets)
        short = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.unique(short[a:b])

    return terms


def pair_sum(vectors: np.ndarray) -> float:
    """Sum over all pairs of rows of their inner product."""
    total = vectors.sum(axis=0)
    return float(total @ total - (vectors * vectors).sum()) / 2


def _learner(m: Machine):
    ftrl, constant = hashed.Ftrl(m.rate, 1.0, m.l1, 0.1), 1 << m.bits
    free = hashed.Ftrl(m.rate, 1.0, 0.0, 0.0)

    def learn(state: list[np.ndarray], rows: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        z, n, v, sq = state
        for label, at in rows:
            w = ftrl.weights(z[at], n[at])
            w0 = free.weights(z[constant : constant + 1], n[constant : constant + 1])
            live = at[w != 0]
            own = v[live]
            p = hashed.logistic(float(w0[0]) + float(w.sum()) + pair_sum(own))
            g = p - label
            ftrl.update(z, n, at, w, g)
            free.update(z, n, np.array([constant]), w0, g)
            if len(live) > 1:
                slope = g * (own.sum(axis=0) - own) + m.vector_l2 * own
                sq[live] += slope * slope
                v[live] = own - m.vector_rate * slope / np.sqrt(sq[live] + 1e-2)
        return state

    return learn


def model(docs: DataFrame, labels: DataFrame, m: Machine) -> list[np.ndarray]:
    rows = hashed.sample(docs, labels, "toxic", m.most_rows, m.shards, _terms(m.bits))
    size = (1 << m.bits) + 1
    v = np.random.default_rng(m.seed).normal(0, 0.05, (size, m.factors)).astype(np.float32)
    return hashed.trained(rows, [np.zeros(size, np.float32), np.zeros(size, np.float32), v, np.zeros((size, m.factors), np.float32)], _learner(m), m.rounds)


def apply(df: DataFrame, labels: DataFrame, m: Machine = Machine(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``df``. ``labels``: doc_id, toxic."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    z, n, v, _ = model(docs, labels.select("doc_id", "toxic"), m)
    w = hashed.Ftrl(m.rate, 1.0, m.l1, 0.1).weights(z[:-1], n[:-1])
    w0 = float(hashed.Ftrl(m.rate, 1.0, 0.0, 0.0).weights(z[-1:], n[-1:])[0])
    live = np.flatnonzero(w)
    held = docs.sparkSession.sparkContext.broadcast((live, w[live], v[live]))

    def score(terms: np.ndarray) -> float:
        live, w, v = held.value
        if not len(live) or not len(terms):
            return w0
        at = np.searchsorted(live, terms)
        at[at == len(live)] = 0
        at = at[live[at] == terms]
        return w0 + float(w[at].sum()) + (pair_sum(v[at]) if len(at) > 1 else 0.0)

    return hashed.scored(docs, _terms(m.bits), score, m.least)


def query(spark, sf_dir: str) -> DataFrame:
    return apply(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
