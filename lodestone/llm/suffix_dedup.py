"""Repeated byte strings by suffix arrays built with linear grouping.

Windows of 100 bytes are found as repeats describes. In each partition, snippets around one anchor whose contents
differ are joined, and a suffix array puts their windows in order, so that equal windows stand side by side. The array
is built without renaming: suffixes are grouped by their longest Lyndon prefix, from the highest group down, each group
extending the groups of the suffixes that its previous-smaller pointers lead to; then each suffix is put into its group
in the order of the suffix that follows its Lyndon prefix."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import STEP_BYTES, U, Kind, covered, dropped, span_hashes
from .shared import saved

WINDOW, PART_WINDOWS = 100, 400_000


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of text in lexicographic order; a suffix stands before those that it begins."""
    n = len(text)
    if n < 2:
        return list(range(n))
    order = array("i", sorted(range(n), key=text.__getitem__))
    group, place, size = (array("i", bytes(4 * n)) for _ in range(3))  # first slot of its group; slot; members of the group at a first slot
    first = 0
    for slot, i in enumerate(order):
        if slot and text[i] != text[order[slot - 1]]:
            first = slot
        group[i], place[i] = first, slot
        size[first] += 1
    length, before = array("i", [1]) * n, array("i", [-1]) * n  # of the known Lyndon prefix; the previous suffix of a lower group
    end = n
    while end:
        own = group[order[end - 1]]
        reached: dict[int, int] = {}
        members = sorted(order[own:end])
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = before[j]
            before[i] = j
            if j >= 0:
                reached[j] = reached.get(j, 0) + 1
        if reached:
            each = length[members[0]]
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in reached.items():
                moved.setdefault((-times, group[j]), []).append(j)
            for (times, old), js in sorted(moved.items()):
                stop = old + size[old]
                new = stop - len(js)
                size[old] -= len(js)
                size[new] = len(js)
                for j in js:  # to the end of its group's slots
                    stop -= 1
                    other, slot = order[stop], place[j]
                    order[slot], order[stop] = other, j
                    place[other], place[j] = slot, stop
                    group[j] = new
                    length[j] -= times * each
        end = own
    last, earlier = array("i", [-1]) * (n + 1), array("i", [-1]) * n  # chains of the suffixes whose Lyndon prefix ends at a place
    for i in range(n):
        after = i + length[i]
        earlier[i] = last[after]
        last[after] = i
    free, out = array("i", range(n)), array("i", bytes(4 * n))
    for slot in range(-1, n):
        i = last[n if slot < 0 else out[slot]]
        while i >= 0:
            at = group[i]
            out[free[at]] = i
            free[at] += 1
            i = earlier[i]
    return out.tolist()


def repeated_windows(contents: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, content, start) of every window that equals another one, by a suffix array over all contents."""
    lengths = np.array([len(c) for c in contents], np.int64)
    if not (lengths >= size).any():
        return (np.zeros(0, np.int64),) * 3
    begin = np.cumsum(lengths + 1) - lengths - 1
    joined = np.zeros(int(lengths.sum()) + len(contents), np.uint16)  # a 0 ends each content
    joined[np.arange(len(joined) - len(contents)) + np.repeat(np.arange(len(contents)), lengths)] = np.frombuffer(b"".join(contents), np.uint8).astype(np.uint16) + 1
    order = np.array(suffix_array(array("H", joined.tobytes())), np.int64)
    content = np.searchsorted(begin, order, side="right") - 1
    start = order - begin[content]
    whole = start <= lengths[content] - size
    order, content, start = order[whole], content[whole], start[whole]
    windows = np.lib.stride_tricks.sliding_window_view(joined, size)
    same = np.zeros(len(order) + 1, bool)  # whether a window equals the one before it in order
    for lo in range(1, len(order), STEP_BYTES // size):
        hi = min(lo + STEP_BYTES // size, len(order))
        same[lo:hi] = (windows[order[lo:hi]] == windows[order[lo - 1 : hi - 1]]).all(1)
    again = same[:-1] | same[1:]
    return np.cumsum(~same[:-1])[again], content[again], start[again]


class Bytes(Kind):
    size, gram, own_starts = WINDOW, 24, True

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def stretches(self, text: bytes) -> Iterator[bytes]:
        for lo in range(0, max(len(text) - self.size + 1, 1), STEP_BYTES):
            yield text[lo : lo + STEP_BYTES + self.size - 1]

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        at = np.arange(max(len(symbols) - self.gram + 1, 0))
        return span_hashes(symbols, at, at + self.gram)

    def packed(self, x: dict, lo: int, hi: int) -> bytes:
        part = slice(lo, hi)
        extent = x["extent"][part]
        left, at = self.size - self.gram, np.arange(x["m"].shape[1])
        inside = (at >= left - extent[:, :1]) & (at < left - extent[:, 1:] + self.size)
        head = np.array([hi - lo], np.int64).tobytes()
        return head + x["owner"][part].tobytes() + x["start"][part].tobytes() + x["key"][part].tobytes() + extent.tobytes() + x["m"][part][inside].tobytes()

    def found(self, blobs: list[bytes]) -> list[np.ndarray]:
        left = self.size - self.gram
        sizes = [int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs]
        take = lambda kind, at, k: np.concatenate([np.frombuffer(b, kind, n * k, 8 + n * at) for b, n in zip(blobs, sizes, strict=True)])
        owner, start, key, extent = take(np.int64, 0, 1), take(np.int64, 8, 1), take(U, 16, 1), take(np.int16, 24, 2).reshape(-1, 2)
        data = b"".join(b[8 + 28 * n :] for b, n in zip(blobs, sizes, strict=True))
        windows = (extent[:, 0] - extent[:, 1]).astype(np.int64) + 1
        length = windows + self.size - 1
        begin = np.cumsum(length) - length
        bits = np.zeros((len(owner), left + 1), bool)
        order = np.argsort(key, kind="stable")  # equal windows have equal keys, so a part of the keys is enough at a time
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        before = np.cumsum(windows[order]) - windows[order]
        part = before[np.flatnonzero(new)][np.cumsum(new) - 1] // PART_WINDOWS
        for one in np.split(order, np.flatnonzero(part[1:] != part[:-1]) + 1):
            content = b"".join([data[b : b + n] for b, n in zip(begin[one].tolist(), length[one].tolist(), strict=True)])
            bits[one] = self._found(owner[one], start[one], key[one], extent[one], content)
        return np.split(bits, np.cumsum(sizes)[:-1])

    def _found(self, owner: np.ndarray, start: np.ndarray, key: np.ndarray, extent: np.ndarray, data: bytes) -> np.ndarray:
        """A row of bits for each snippet; data holds their contents one after another."""
        left = self.size - self.gram
        windows = (extent[:, 0] - extent[:, 1]).astype(np.int64) + 1
        length = windows + self.size - 1
        begin = np.cumsum(length) - length
        h, whole = np.empty(int(windows.sum()), U), np.frombuffer(data, np.uint8)
        edges = np.searchsorted(begin, np.arange(0, len(whole) + STEP_BYTES, STEP_BYTES))
        first = np.cumsum(windows) - windows
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if lo < hi:  # so that no table of powers must cover the whole
                n = windows[lo:hi]
                s = np.repeat(begin[lo:hi] - begin[lo] - (first[lo:hi] - first[lo]), n) + np.arange(n.sum())
                h[first[lo] : first[hi - 1] + windows[hi - 1]] = span_hashes(whole[begin[lo] : begin[hi - 1] + length[hi - 1]], s, s + self.size)
        ordered = np.sort(h)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        again = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h if len(twice) else np.zeros(len(h), bool)
        del h  # a filter: what isn't here has no equal
        hits = np.flatnonzero(again)
        of = np.searchsorted(first, hits, side="right") - 1
        at = hits - first[of]
        bits = np.zeros((len(owner), left + 1), bool)
        if again.any():
            entry, place = of, at
            cut = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
            entry, lo, hi = entry[cut], place[cut], place[np.append(cut[1:], len(place)) - 1]
            groups: dict[int, dict[tuple[bytes, int], list[int]]] = {}
            for e, a, z in zip(entry.tolist(), lo.tolist(), hi.tolist(), strict=True):
                b = int(begin[e])
                groups.setdefault(int(key[e]), {}).setdefault((data[b + a : b + z + self.size], int(extent[e, 0]) - a), []).append(e)
            for contents in groups.values():
                least = []
                for (content, back), entries in contents.items():
                    n = len(content) - self.size + 1  # its windows start from back symbols before the anchor on
                    e = min(entries, key=lambda e: (owner[e], start[e]))
                    least.append((int(owner[e]), int(start[e]), e, back))
                    for x in entries:
                        if x != e:
                            bits[x, back - n + 1 : back + 1] = True
                if len(contents) > 1:
                    own = np.array(least, np.int64)  # of each content: owner and start of its least entry, the entry, windows before the anchor
                    cls, k, i = repeated_windows([c for c, _ in contents], self.size)
                    back = own[k, 3] - i
                    order = np.lexsort((own[k, 1] - back, own[k, 0], cls))
                    later = order[1:][cls[order][1:] == cls[order][:-1]]
                    bits[own[k[later], 2], back[later]] = True
        return bits


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    A byte goes if it lies in 100 bytes of its document that also start earlier: in a document with a smaller id, or
    earlier in the same one. A null text is empty. Rows with one id count as one document, in which starts are compared
    and equal starts aren't earlier; rows without an id come after all others. Other columns are not looked at. An
    empty table gives an empty result."""

    def finish(t: pa.Table, texts: list[bytes], masks: list[np.ndarray]) -> pa.Table:
        gone, spans, hashes = [], [], []
        for text, mask in zip(texts, masks, strict=True):
            gone.append(int(mask.sum()))
            spans.append(int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum()))
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if gone[-1] else text
            hashes.append(hashlib.sha256(kept).hexdigest())
        n = [len(x) for x in texts]
        return pa.table([t["doc"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found, texts = covered(Bytes(), docs, id_col, text_col, finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    found = saved(found)
    dropped(docs.sparkSession, texts)
    return found
