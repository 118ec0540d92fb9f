"""Repeated word passages by prefix-partitioned suffix trees.

Suffixes that start at a window around an anchor (see repeats) are partitioned by their anchor, five words that they
share, and those of a prefix that is too frequent by their whole window. In a partition they are dealt into subtrees that
fit a budget: by prefixes of one word more wherever a subtree is larger. A subtree grows from its root word by word; a
node is a distinct run of words, and one that a single suffix reaches isn't followed any further. Internal nodes 13 words
deep are the repeats, and the least of the documents below one tells which of its windows come later."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import HELD, PRIME, STEP_BYTES, U, Kind, covered, dropped, mixed, span_hashes
from .shared import saved

WINDOW, SUBTREE, SHORT = 13, 400_000, 64
BLANK = b" \t\n\x0b\x0c\r"


class Words(Kind):
    """Words as 64-bit numbers under a key of the run, so that no text can be made to clash.

    A word of up to SHORT bytes is a polynomial over secret numbers of its bytes. Longer ones, for which there are words that
    any polynomial modulo 2**64 takes for equal, are hashed by keyed BLAKE2b."""

    size, gram, own_starts = WINDOW, 5, False

    def __init__(self, key: bytes | None = None):
        self.key = key or os.urandom(16)
        self.table = np.frombuffer(b"".join(blake2b(bytes([i]), digest_size=8, key=self.key, person=b"bytes").digest() for i in range(256)), U)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = b"\n".join([*texts, b""])
        data = np.frombuffer(whole, np.uint8)
        blank = np.empty(len(data) + 1, bool)
        blank[0] = True
        blank[1:] = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edge[::2], edge[1::2]
        text_at = np.cumsum([0, *[len(t) + 1 for t in texts]])
        out = span_hashes(data, starts, ends, self.table)
        for i in np.flatnonzero(ends - starts > SHORT).tolist():
            out[i] = int.from_bytes(blake2b(whole[starts[i] : ends[i]], digest_size=8, key=self.key).digest(), "little")
        return out, np.searchsorted(starts, text_at)

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        n = max(len(symbols) - self.gram + 1, 0)
        h = symbols[:n].copy()
        for i in range(1, self.gram):
            h = h * U(PRIME) + symbols[i : n + i]
        return mixed(h)

    def stretches(self, text: bytes) -> Iterator[bytes]:
        lo = 0
        while True:
            hi = lo
            while True:  # so far that it holds more words than it shares with the next one
                hi += STEP_BYTES
                while hi < len(text) and text[hi] not in BLANK:
                    hi = min([at for c in BLANK if (at := text.find(c, hi, hi + STEP_BYTES)) >= 0], default=hi + STEP_BYTES)
                parts = text[lo:hi].rsplit(None, self.size - 1)
                if hi >= len(text) or len(parts) == self.size and parts[0].strip():
                    break
            yield text[lo:hi]
            if hi >= len(text):
                return
            lo += len(parts[0])

    def packed(self, x: dict, lo: int, hi: int) -> bytes:
        part = slice(lo, hi)
        extent = x["extent"][part]
        return np.array([hi - lo], np.int64).tobytes() + x["owner"][part].tobytes() + x["key"][part].tobytes() + extent.tobytes() + x["m"][part][self._inside(extent)].tobytes()

    def _inside(self, extent: np.ndarray) -> np.ndarray:
        left = self.size - self.gram
        at = np.arange(left + self.size)
        return (at >= left - extent[:, :1]) & (at < left - extent[:, 1:] + self.size)

    def found(self, blobs: list[bytes]) -> list[np.ndarray]:
        sizes = [int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs]
        take = lambda kind, at, k: np.concatenate([np.frombuffer(b, kind, n * k, 8 + n * at) for b, n in zip(blobs, sizes, strict=True)])
        owner, key, extent = take(np.int64, 0, 1), take(U, 8, 1), take(np.int16, 16, 2).reshape(-1, 2)
        words = np.concatenate([np.frombuffer(b, U, -1, 8 + 20 * n) for b, n in zip(blobs, sizes, strict=True)])
        windows = (extent[:, 0] - extent[:, 1]).astype(np.int64) + 1
        length = windows + self.size - 1
        begin = np.cumsum(length) - length
        row = np.repeat(np.arange(len(owner)), windows)
        after = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)  # of the window in its snippet
        back = extent[row, 0] - after
        suffixes = Suffixes(words, begin[row] + after, self.size)
        bits = np.zeros((len(owner), self.size - self.gram + 1), bool)
        for at, node in suffixes.deep(key[row] * U(PRIME) + back.astype(U)):
            o = owner[row[at]]
            order = np.lexsort((o, node))
            node, o, at = node[order], o[order], at[order]
            cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            bits[row[at], back[at]] = np.repeat(o[cut], np.diff(np.append(cut, len(o)))) < o
        return np.split(bits, np.cumsum(sizes)[:-1])


class Suffixes:
    """Suffixes of words (at start) as subtrees down to a depth."""

    def __init__(self, words: np.ndarray, start: np.ndarray, depth: int):
        self.words, self.start, self.depth = words, start, depth

    def deep(self, root: np.ndarray, budget: int = SUBTREE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(suffixes, node) of the internal nodes at full depth, one subtree or several small ones at a time."""
        at, node = self._split(np.arange(len(root)), root)
        waiting = [(0, at, node)]
        while waiting:
            d, at, node = waiting.pop()
            while len(at) and d < self.depth and len(at) <= budget:
                at, node = self._split(at, node, self.words[self.start[at] + d])
                d += 1
            if d == self.depth:
                if len(at):
                    yield at, node
            elif len(at):  # too large: as many whole nodes at a time as fit, or one with a longer prefix
                cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                part = cut // budget
                lo = cut[np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))]
                if len(lo) == 1:
                    at, node = self._split(at, node, self.words[self.start[at] + d])
                    waiting.append((d + 1, at, node))
                else:
                    waiting += [(d, at[i:j], node[i:j]) for i, j in zip(lo, np.append(lo[1:], len(at)), strict=True)]

    @staticmethod
    def _split(at: np.ndarray, node: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes by the children of their nodes, in order, without children that one suffix alone reaches."""
        order = np.argsort(node, kind="stable") if word is None else np.lexsort((word, node))
        at, keys = at[order], [x[order] for x in (node, word) if x is not None]
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        kept = ~(new[:-1] & new[1:])
        return at[kept], np.cumsum(new[:-1])[kept]


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256) for each row of docs.

    A word goes if it lies in 13 words of its document that also start in a document with a smaller id. A null text has
    no words. Rows with one id are one document, none earlier than the other; rows without an id come after all others.
    Other columns are not looked at. An empty table gives an empty result."""

    def finish(t: pa.Table, texts: list[bytes], masks: list[np.ndarray]) -> pa.Table:
        kept, hashes = [], []
        for text, mask in zip(texts, masks, strict=True):
            words = text.split()
            if mask.any():
                words = list(compress(words, ~mask))
            kept.append(len(words))
            hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
        n = np.array([len(m) for m in masks], np.int64)
        return pa.table([t["doc"], pa.array(n), pa.array(n - np.array(kept, np.int64)), pa.array(hashes, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    found, texts = covered(Words(), docs, id_col, text_col, finish, "id long, n_words long, n_removed long, kept_sha256 string")
    found = saved(found)
    dropped(docs.sparkSession, texts)
    return found


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated words taken out of their texts; texts without any stay as they are. Cases as in removed().

    The rows are computed where they are written; until then their texts lie in a table of the checkpoint folder, which repeats.release() drops."""
    names = docs.columns
    at = names.index(text_col)
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    keep = tuple(f"c{i}" for i in range(len(names)) if i != at)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def finish(t: pa.Table, texts: list[bytes], masks: list[np.ndarray]) -> pa.Table:
        out = [b" ".join(compress(text.split(), ~mask)) if mask.any() else text for text, mask in zip(texts, masks, strict=True)]
        cols = [pa.array(out, pa.binary()).cast(pa.string()) if i == at else t[f"keep_c{i}"] for i in range(len(names))]
        return pa.table(cols, names=[f"c{i}" for i in range(len(names))])

    found, texts = covered(Words(), docs.select(*columns), f"c{names.index(id_col)}", f"c{at}", finish, schema, keep)
    HELD.append((docs.sparkSession, texts))
    return found.toDF(*names)
