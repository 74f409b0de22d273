"""Vectorised words, word hashes and character n-grams over batches of whole texts.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed
and carriage return. Work runs in pieces of bounded size, so one very long text needs no more
scratch memory than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = {"up": _powers(_BASE, PIECE + 1), "down": _powers(_BACK, PIECE + 1)}


def _power(kind: str, n: int) -> np.ndarray:
    if n > len(_POW[kind]):
        return _powers(_BASE if kind == "up" else _BACK, n)
    return _POW[kind][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column of texts end to end, and the n + 1 offsets; null is empty."""
    if column.null_count:
        column = pa.array([x or "" for x in column.to_pylist()], pa.string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_024) -> Iterator[pa.RecordBatch]:
    """Batches cut short, so that few texts stand in Python's memory at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE bytes that end at a text's end or at white space."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + PIECE, end)
        if to < end:
            ends = offsets[np.searchsorted(offsets, to, "right") - 1]
            if ends <= at:
                gaps = np.flatnonzero(SPACE[data[at:to]])
                if len(gaps):
                    ends = at + gaps[-1] + 1
                else:
                    stop = int(offsets[np.searchsorted(offsets, to, "left")])
                    gaps = np.flatnonzero(SPACE[data[to:stop]])
                    ends = to + gaps[0] + 1 if len(gaps) else stop
            to = int(ends)
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (in bytes) of every word, and for each text the number of its first word."""
    hashes, starts, ends = [], [], []
    with np.errstate(over="ignore"):
        for a, b in _cuts(data, offsets):
            part = LOWERED[data[a:b]] if lower else data[a:b]
            n = b - a
            inside = ~SPACE[part]
            first = np.zeros(n + 1, bool)
            edges = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "right")] - a
            first[edges] = True
            before = np.empty(n, bool)
            before[0] = False
            before[1:] = inside[:-1]
            s = np.flatnonzero(inside & (~before | first[:n]))
            after = np.zeros(n, bool)
            after[:-1] = inside[1:]
            e = np.flatnonzero(inside & (~after | first[1:])) + 1
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power("up", n), dtype=np.uint64, out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * _power("down", n + 1)[s] + (e - s).astype(np.uint64)))
            starts.append(s + a)
            ends.append(e + a)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    start = join(starts, np.int64)
    return join(hashes, np.uint64), start, join(ends, np.int64), np.searchsorted(start, offsets, "left")


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and word position of every window of `width` words that lies in one text."""
    n = len(words) - width + 1
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for k in range(1, width):
            h = mix(h) + words[k : k + n]
        whole = text[:n] == text[width - 1 :]
        at = np.flatnonzero(whole)
        return mix(h[at]), text[at], at


def groups(sizes: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to about `most`; a larger row makes a run of its own."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b
