"""Stretches of words that repeat with a period, by Main and Lorentz's divide and conquer.

The words of a text are interned as numbers. Of a segment, the repetitions that cross its middle come from how far the
second half agrees with the text from each place on, and how far the first half agrees with the text up to each place:
two Z-functions, one of them backwards. With period q the two agreements around the middle add up to q at least. What
goes on beyond the segment crosses the middle of a larger one and is found there; the halves are looked at alone. One
stretch is found with its period and with multiples of it, and keeps the smallest.

A stretch of twelve words or more that repeats holds six words twice, so a segment in which no six words occur twice is
left out; equal hashes only mean that a segment is searched. Each text is searched alone, in n log n steps, where it
lies: nothing is shuffled."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, ROWS, BYTES = 12, 500, 4 << 20
U = np.uint64


def agreements(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each place of text, how many symbols from there on agree with the start of pattern (a Z-function)."""
    s = np.concatenate([pattern, [-1], text])
    values, z, left, right, n = s.tolist(), [0] * len(s), 0, 0, len(s)
    for i in (np.flatnonzero(s[1:] == s[0]) + 1).tolist():  # elsewhere nothing agrees
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and values[k] == values[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return np.array(z[len(pattern) + 1 :], np.int64)


def crossing(x: np.ndarray, lo: int, mid: int, hi: int, least: int = LEAST) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the maximal repetitions in x[lo:hi] that cross mid; none that goes on outside."""
    u, v = x[lo:mid], x[mid:hi]
    nu, nv, n = len(u), len(v), len(x)
    ahead = np.append(agreements(v, x[lo:hi]), 0)
    back = np.append(agreements(u[::-1], x[lo:hi][::-1]), 0)
    q = np.arange(1, (hi - lo) // 2 + 1)
    r, l = q[q <= nv], q[q <= nu]  # noqa: E741
    right, left = (back[nv - r], ahead[nu + r]), (back[nv + l], ahead[nu - l])  # agreement before and after the middle
    for period, (before, after), shift in ((r, right, 0), (l, left, 1)):
        both = before + after
        hit = np.flatnonzero((both >= period) & (both + period >= least))
        p, s = period[hit], mid - before[hit] - shift * period[hit]
        for start, end, k in zip(s.tolist(), (s + both[hit] + p).tolist(), p.tolist(), strict=True):
            if not (start == lo > 0 and x[lo - 1] == x[lo - 1 + k] or end == hi < n and x[hi] == x[hi - k]):
                yield start, end, k


def runs_of(x: np.ndarray, earlier: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of each maximal repetition of x, by start, then period.

    earlier: for each place, one before it where the same six symbols start, the nearest, or -1."""
    found: dict[tuple[int, int], int] = {}
    waiting = [(0, len(x))]
    while waiting:
        lo, hi = waiting.pop()
        if hi - lo < least or earlier[lo : hi - GRAM + 1].max() < lo:
            continue
        mid = (lo + hi) // 2
        for start, end, period in crossing(x, lo, mid, hi, least):
            found[start, end] = min(period, found.get((start, end), period))
        waiting += [(lo, mid), (mid, hi)]
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda run: (run[0], run[2]))


GRAM = 6  # a repetition with period q and max(12, 2q) words or more has max(12 - q, q) words that occur q further on


def earlier_places(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each place of x, texts between bounds, the nearest one before it in its text with equal six symbols, or -1."""
    n = len(x) - GRAM + 1
    out = np.full(len(x), -1, np.int64)
    if n < 2:
        return out
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = text[:n].astype(U)
    for i in range(GRAM):
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) + x[i : n + i].astype(U)
    inside = np.flatnonzero(text[:n] == text[GRAM - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def searched(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    x = np.fromiter((ids[w] for t in texts for w in t), np.int64, sum(map(len, texts)))
    bounds = np.cumsum([0, *map(len, texts)])
    earlier = earlier_places(x, bounds)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        before = earlier[lo:hi]
        out.append(runs_of(x[lo:hi], np.where(before < 0, -1, before - lo)) if hi - lo >= LEAST and before.max() >= 0 else [])
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that lie in a run beyond its first period."""
    if not runs:
        return b" ".join(words)
    start, length, period = np.array(runs, np.int64).T
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return b" ".join(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Rows (id, n_words, runs, collapsed) for each row of docs: runs are structs of start, length and period in words.

    Words are runs of characters other than ASCII white space. edit, if given, changes the words of a document before
    they are searched. A null or empty text has no words and no runs, and collapses to an empty text; a null id stays
    null; rows that repeat are searched as often as they come; texts are whole, however long, one at a time. Runs that
    overlap, also with equal starts, are all returned. Other columns are not looked at. An empty table gives an empty result."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                ids = b.column(0).to_pylist()
                texts = [(t or b"").split() for t in b.column(1).cast(pa.binary()).to_pylist()]
                if edit is not None:
                    texts = [edit(i, t) for i, t in zip(ids, texts, strict=True)]
                runs = searched(texts)
                flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
                each = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), each)
                kept = pa.array([collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), lists, kept], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of some rows and BYTES of text, a longer text alone."""
    sizes = np.cumsum(np.nan_to_num(pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(float)))
    lo = 0
    while lo < b.num_rows:
        done = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + ROWS, int(np.searchsorted(sizes, done + BYTES, "right"))))
        yield b.slice(lo, hi - lo)
        lo = hi
