"""Operator 9: token counts by offset-mapped attribution.

A document is encoded once and whole, never by parts, since tokens may cross the border of parts. The tokens'
byte lengths, summed, are their spans in the text. Sections (by default lines, each with its line break) are
spans too, and both lists are joined as intervals, by binary search on the sorted borders.

*Rule for tokens that cross a border:* a token counts for the section that holds most of its bytes, the earlier one
if several hold as many. So every token counts once, and a document's sections add up to its tokens.

The vocabulary is a file of ranks (a token in base 64 and its rank on each line). The driver reads it once and
broadcasts it (1 MB); tasks build the encoder once for each worker.

Defined results: null and empty texts have no tokens and no sections; repeated rows are counted each; an empty
table gives an empty table. Spans of sections are code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: how the vocabulary's authors split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_built: dict[tuple[str, bytes], tuple] = {}


@dataclass(frozen=True)
class Vocabulary:
    """A file of ranks and the pattern that goes with it. ``path`` none: the byte-level one that is installed."""

    path: str | None = None
    pattern: str = PATTERN

    def read(self) -> bytes:
        path = self.path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            return f.read()


def encoder(raw: bytes, pattern: str):
    """The encoder and each token's bytes; built once for each worker."""
    import tiktoken

    key = (pattern, hashlib.sha256(raw).digest())
    if key not in _built:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            sizes[k] = len(token)
        _built[key] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _built[key]


def attributed(token_ends: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a border. ``borders``: the sections' ends, in bytes."""
    counts = np.zeros(len(borders), np.int64)
    if not len(token_ends):
        return counts, 0
    begins = np.concatenate([[0], token_ends[:-1]])
    low = np.searchsorted(borders, begins, "right")  # section of the first and of the last byte
    high = np.searchsorted(borders, token_ends, "left")
    cross = np.flatnonzero(low != high)
    for t in cross.tolist():
        a, b, best = int(begins[t]), int(token_ends[t]), (-1, 0)
        for s in range(int(low[t]), int(high[t]) + 1):
            held = min(b, int(borders[s])) - max(a, int(borders[s - 1]) if s else 0)
            if held > best[0]:
                best = (held, s)
        low[t] = best[1]
    np.add.at(counts, low, 1)
    return counts, len(cross)


def sections(data: np.ndarray) -> np.ndarray:
    """Ends of the lines of a text, in bytes."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if not len(data) or len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def apply(df: DataFrame, vocabulary: Vocabulary = Vocabulary(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, sections (array of begin, end, tokens) for each row."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary.read())
    pattern = vocabulary.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoder(raw.value, pattern)
        span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32())])
        for batch in batches:
            totals, crossing, offsets, begins, ends, tokens = [], [], [0], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                data = np.frombuffer(text.encode(), np.uint8)
                ids = np.array(coder.encode_ordinary(text), np.int64)
                borders = sections(data)
                counts, cross = attributed(np.cumsum(sizes[ids]) if len(ids) else ids, borders)
                char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                totals.append(len(ids))
                crossing.append(cross)
                offsets.append(offsets[-1] + len(borders))
                ends.append(char[borders])
                begins.append(np.concatenate([[0], char[borders][:-1]]) if len(borders) else borders)
                tokens.append(counts)
            cat = lambda x: pa.array(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32))
            held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([cat(begins), cat(ends), cat(tokens)], fields=list(span)))
            columns = [batch.column(0), pa.array(totals, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crossing, pa.int64()), held]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_sections", "n_crossing", "sections"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_sections bigint, n_crossing bigint, sections array<struct<begin:int,end:int,tokens:int>>")


def query(spark, sf_dir: str) -> DataFrame:
    return apply(common.table(spark, sf_dir, "documents"))
