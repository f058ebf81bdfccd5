"""Vectorised reading of words from Arrow string columns: no Python object is made per word.

Everything here works on one Arrow batch inside a task. Long texts are read piece by piece, so memory
follows the number of words of the longest text, not its bytes times a constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: True for bytes that are neither ASCII letters or digits nor part of a longer character.
NOT_WORD = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
#: True for bytes that are no ASCII symbol.
NOT_SYMBOL = ~NOT_WORD | np.array([b < 33 or b == 127 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, _PIECE + 1)
        base, inverse = int(_ODD), pow(int(_ODD), -1, 1 << 64)
        for name, b in (("up", base), ("down", inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def rows_by_size(offsets: np.ndarray, limit: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each; a longer row is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, hashed: bool = True, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (in ``data``) and 64-bit hash of each word, in order; words end where their row ends.
    ``space``: for each byte, whether it separates words."""
    starts, ends, hashes = [], [], []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + _PIECE)
        if to < n:  # go back to a gap or a row's end; if there is none, go on to the next
            gap = np.flatnonzero(space[data[at:to]])
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            back = max(row, at + int(gap[-1]) + 1 if len(gap) else at)
            if back > at:
                to = back
            else:
                row = int(offsets[np.searchsorted(offsets, to, "left")])
                while to < row and not space[data[to - 1]]:
                    step = data[to : min(row, to + _PIECE)]
                    gap = np.flatnonzero(space[step])
                    to += int(gap[0]) + 1 if len(gap) else len(step)
        piece = data[at:to]
        gaps = space[piece]
        edge = np.zeros(len(piece) + 1, bool)
        inner = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, to, "right")] - at
        edge[inner] = True
        before = np.ones(len(piece) + 1, bool)
        before[1:] = gaps
        after = np.ones(len(piece) + 1, bool)
        after[:-1] = gaps
        s = np.flatnonzero(~after & (before | edge))
        e = np.flatnonzero(~before & (after | edge))
        starts.append(s + at)
        ends.append(e + at)
        if hashed:
            up, down = _tables(len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((_LOWER[piece] if lower else piece).astype(np.uint64) * up[: len(piece)] + up[: len(piece)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _ODD))
        at = to
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)


def row_slices(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the index of its first word, and the number of words at the end."""
    return np.searchsorted(starts, offsets, "left")


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n words (of one text)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + m]
    return mix(out)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingles of n words; fewer words count as one shingle; no words, none."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(grams(hashes, min(n, len(hashes))) ^ np.uint64(min(n, len(hashes))))
