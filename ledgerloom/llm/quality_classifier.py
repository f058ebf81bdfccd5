"""Operator 7: quality by logistic regression over hashed word n-grams, learnt by follow-the-regularised-leader updates.

Terms of a text, each counted once: its words as written, its runs of symbols, and pairs of neighbouring words.
Words that no training text holds say nothing, so n-grams also back off to a word's form: words in capitals,
words that equal the word before, words with a symbol run at their end. Scores are sparse dot products with
the weights that are not zero.

Training: see ``hashed``. It takes at most ``most_rows`` labelled rows; every document is scored whole.

Defined results: null and empty texts have one term for having no words; without any label to learn from, all scores are
0.5; repeated rows are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashed, textkit


@dataclass(frozen=True)
class Classifier:
    """Parameters."""

    bits: int = 18
    most_rows: int = 24_000
    shards: int = 4
    rounds: int = 4
    rate: float = 0.1
    l1: float = 1.0
    l2: float = 0.5
    least: float = 0.3


_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])


def _terms(bits: int):
    shift = np.uint64(64 - bits)
    salt = textkit.mix(np.arange(1, 100, dtype=np.uint64))

    def terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        starts, ends, hashes = textkit.words(data, offsets, lower=False, space=textkit.NOT_WORD)
        s_starts, _, s_hashes = textkit.words(data, offsets, lower=False, space=textkit.NOT_SYMBOL)
        upto = lambda mask: np.concatenate([[0], np.cumsum(mask[data])])
        capitals, letters = upto(_CAPITAL), upto(_LETTER)
        inside = lambda x: x[ends] - x[starts]
        capital = (inside(capitals) == inside(letters)) & (inside(letters) > 1)
        repeat = np.zeros(len(hashes), bool)
        repeat[1:] = hashes[1:] == hashes[:-1]
        marked = np.zeros(len(hashes), bool)
        if len(s_starts):
            at = np.searchsorted(s_starts, ends)
            at[at == len(s_starts)] = 0
            marked = s_starts[at] == ends
        pairs = textkit.grams(hashes, 2)
        first, s_first = textkit.row_slices(starts, offsets), textkit.row_slices(s_starts, offsets)
        for a, b, c, d in zip(first[:-1].tolist(), first[1:].tolist(), s_first[:-1].tolist(), s_first[1:].tolist()):
            forms = []
            for k, form in enumerate((capital, repeat, marked)):
                if count := int(form[a:b].sum()):
                    forms += [4 * k + 4 + i for i in range(1 + min(3, 4 * count // (b - a)))]
            forms.append(32 + min(10, int(np.log2(b - a + 1))))
            own = np.concatenate([hashes[a:b], s_hashes[c:d] ^ salt[0], pairs[a : max(a, b - 1)] ^ salt[1], salt[forms]])
            yield np.unique(own >> shift).astype(np.int64)

    return terms


def _learner(c: Classifier):
    ftrl, free, constant = hashed.Ftrl(c.rate, 1.0, c.l1, c.l2), hashed.Ftrl(c.rate, 1.0, 0.0, 0.0), 1 << c.bits

    def learn(state: list[np.ndarray], rows: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        z, n = state
        for label, at in rows:
            w = ftrl.weights(z[at], n[at])
            w0 = free.weights(z[constant : constant + 1], n[constant : constant + 1])
            g = hashed.logistic(float(w0[0]) + float(w.sum())) - label
            ftrl.update(z, n, at, w, g)
            free.update(z, n, np.array([constant]), w0, g)
        return state

    return learn


def apply(df: DataFrame, labels: DataFrame, c: Classifier = Classifier(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``df``. ``labels``: doc_id, quality."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    rows = hashed.sample(docs, labels.select("doc_id", "quality"), "quality", c.most_rows, c.shards, _terms(c.bits))
    size = (1 << c.bits) + 1
    z, n = hashed.trained(rows, [np.zeros(size, np.float32), np.zeros(size, np.float32)], _learner(c), c.rounds)
    w = hashed.Ftrl(c.rate, 1.0, c.l1, c.l2).weights(z[:-1], n[:-1])
    w0 = float(hashed.Ftrl(c.rate, 1.0, 0.0, 0.0).weights(z[-1:], n[-1:])[0])
    held = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))
    return hashed.scored(docs, _terms(c.bits), lambda terms: w0 + float(held.value[terms].sum()), c.least)


def query(spark, sf_dir: str) -> DataFrame:
    return apply(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
