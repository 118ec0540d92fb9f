"""What the two duplicate-passage operators share: finding windows of symbols that also occur elsewhere.

Texts are stored once in groups that a task can hold, bucketed by group, so that later steps come back to the same
texts without moving them. Each window of symbols has an anchor: the gram in it with the least hash, the leftmost of
equals. Equal windows have equal anchors at equal places, so that

1. groups send the hashes of their distinct anchors, and learn which occur elsewhere too (a bit or two for each);
2. groups send the distinct snippets around those anchors, partitioned by the anchor, their common prefix;
3. an index built over each partition tells for every window of a snippet whether an earlier one equals it;
4. groups put the answers back on their texts.

Copies inside a group are one snippet, so a passage that a third of all texts share is sent once for each group. If an
anchor still has very many contents, because what stands around it varies, each of its windows is sent under its own whole
content instead: the prefix that partitions is as long as it must be. Groups of texts hold GROUP_BYTES, partitions of
snippets some BUCKET_BYTES, whatever the corpus; a text that is longer is read in steps that overlap by a window."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint_dir, partitions_for, released, saved

GROUP_BYTES, BUCKET_BYTES, STEP_BYTES, HOT, CELLS = 8 << 20, 16 << 20, 1 << 19, 4096, 500_000
PRIME = 0x100000001B3
U = np.uint64


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of PRIME and of its inverse modulo 2**64."""
    one = np.ones(1, U)
    up, down = np.full(n, PRIME, U), np.full(n, pow(PRIME, -1, 2**64), U)
    return np.cumprod(np.concatenate([one, up])), np.cumprod(np.concatenate([one, down]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of data[start:end] for spans of symbols; table, if given, has a number for each byte."""
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1) if table is None else table[data]) * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values, the index of its least, the leftmost of equals."""
    best, at, w = values, np.arange(len(values)), 1
    while w < width:
        s = min(w, width - w)
        right = best[s:] < best[: len(best) - s]
        at = np.where(right, at[s:], at[: len(at) - s])
        best = np.where(right, best[s:], best[: len(best) - s])
        w += s
    return at


@dataclass
class Step:
    """Some whole texts, or a stretch of one, as symbols, and the runs of windows that share an anchor."""

    base: int  # number of texts before
    offset: int  # of the symbols in their text
    overlap: int  # how many symbols the step before has seen too
    symbols: np.ndarray
    bounds: np.ndarray  # of each text in symbols
    anchor: np.ndarray  # of each run: place of its anchor, hash of it, first and last window, text
    key: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray


class Kind:
    """Windows of size symbols with anchors of gram symbols; see the subclasses in the operators' modules."""

    size: int
    gram: int
    own_starts: bool  # whether an equal window of the same text, further on, counts as a repeat

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def stretches(self, text: bytes) -> Iterator[bytes]:
        """A long text in stretches, each of which begins with the last size - 1 symbols of the one before."""
        raise NotImplementedError

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def found(self, snippets: list[dict]) -> list[np.ndarray]:
        """For blobs of snippets: for each snippet, a row of size bits: is the window that starts so many symbols before the anchor a repeat."""
        raise NotImplementedError

    def steps(self, texts: list[bytes]) -> Iterator[Step]:
        lo = 0
        while lo < len(texts):
            hi, n = lo + 1, len(texts[lo])
            if n > STEP_BYTES:
                offset = overlap = 0
                for stretch in self.stretches(texts[lo]):
                    s = self.step([stretch], lo, offset, overlap)
                    yield s
                    overlap = self.size - 1
                    offset += len(s.symbols) - overlap
                lo = hi
                continue
            while hi < len(texts) and n + len(texts[hi]) <= STEP_BYTES:
                n += len(texts[hi])
                hi += 1
            yield self.step(texts[lo:hi], lo)
            lo = hi

    def step(self, texts: list[bytes], base: int, offset: int = 0, overlap: int = 0) -> Step:
        symbols, bounds = self.read(texts)
        counts = np.maximum(np.diff(bounds) - self.size + 1, 0)
        none = np.zeros(0, np.int64)
        if not counts.sum():
            return Step(base, offset, overlap, symbols, bounds, none, none.astype(U), none, none, none)
        text = np.repeat(np.arange(len(texts)), counts)
        p = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[:-1], counts)
        grams = self.grams(symbols)
        a = leftmost_least(grams, self.size - self.gram + 1)[p]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]))
        end = np.append(new[1:], len(p)) - 1
        return Step(base, offset, overlap, symbols, bounds, a[new], mixed(grams[a[new]] + U(PRIME)), p[new], p[end], text[new])  # mixed, as least hashes are all low


def stored(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, str, int]:
    """The texts in groups (g) with row numbers (row), the name of their table, and their bytes.

    They are written once, bucketed by group. A group is a stretch of a partition of GROUP_BYTES, or one longer text."""
    spark = docs.sparkSession
    n = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    rows = docs.select(F.lit(0).cast("long").alias("g"), F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for b in batches:
            ends = before + np.cumsum(pa.compute.binary_length(b.column(3)).to_numpy(zero_copy_only=False).astype(np.int64))
            if len(ends):
                before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array((part << 32) + ends // GROUP_BYTES), *b.columns[1:]], b.schema.names)

    name = "lodestone_" + uuid.uuid4().hex
    buckets = min(max(1, docs.rdd.getNumPartitions() + n // GROUP_BYTES), 100_000)
    rows.mapInArrow(grouped, rows.schema).write.format("parquet").option("path", f"{checkpoint_dir(spark)}/{name}").bucketBy(buckets, "g").saveAsTable(name)
    return spark.table(name), name, n


def dropped(spark: SparkSession, name: str) -> None:
    """Removes a table of stored() and its files, once nothing reads it any more."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of stored() whose rows wait to be written, by session.
HELD: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Drops the tables that rows of substring_dedup.cleaned() are read from; call it once these have been written."""
    while HELD:
        dropped(*HELD.pop())


def _of_group(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], pa.Table]:
    t = t.take(pa.array(np.argsort(t["row"].to_numpy(), kind="stable")))
    docs = t["doc"].fill_null(2**63 - 1).to_numpy()  # rows without an id come last
    return docs, t["row"].to_numpy(), t["text"].to_pylist(), t


def _releasing(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f for one table of a group, giving freed memory back after each."""

    @wraps(f)
    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        released()
        return out

    return run


def _releasing_both(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """f for two tables of a group, giving freed memory back after each."""

    @wraps(f)
    def run(t: pa.Table, other: pa.Table) -> pa.Table:
        out = f(t, other)
        released()
        return out

    return run


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _slices(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array of buckets."""
    if len(buckets):
        cut = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        yield from zip(buckets[cut].tolist(), cut.tolist(), np.append(cut[1:], len(buckets)).tolist(), strict=True)


def _content_hashes(kind: Kind, s: Step, first: np.ndarray, last: np.ndarray, extent: np.ndarray) -> np.ndarray:
    """Of the symbols from each first window to the end of the last, and of where the anchor stands in them."""
    place = extent[:, 0].astype(U) * U(512) + extent[:, 1].astype(U) + U(1)
    return mixed(span_hashes(s.symbols, first, last + kind.size) ^ place * U(0x9E3779B97F4A7C15))


def _distinct_anchors(kind: Kind, docs: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes in order, how many contents each has, and whether two texts (or places, if these count) hold it."""
    keys, contents, owners = [], [], []
    for s in kind.steps(texts):
        keys.append(s.key)
        contents.append(_content_hashes(kind, s, s.first, s.last, np.stack([s.anchor - s.first, s.anchor - s.last], 1)))
        owners.append(docs[s.text + s.base])
    key, content = (np.concatenate(x) if x else np.zeros(0, U) for x in (keys, contents))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((content, key))
    key, content, owner = key[order], content[order], owner[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    cut = np.flatnonzero(new)
    new[1:] |= content[1:] != content[:-1]
    several = np.diff(np.append(cut, len(key))) > 1 if kind.own_starts else np.maximum.reduceat(owner, cut) > np.minimum.reduceat(owner, cut)
    return key[cut], np.add.reduceat(new.astype(np.int64), cut), several


REPLY = "g long, bucket int, data binary"


def _repeated_anchors(kind: Kind, texts: DataFrame, buckets: int) -> DataFrame:
    """(g, bucket, data): for each distinct anchor of a group in order, 0, 1 if it occurs elsewhere, 2 if it is hot."""

    @_releasing
    def sent(t: pa.Table) -> pa.Table:
        docs, _, raw, _ = _of_group(t)
        key, counts, several = _distinct_anchors(kind, docs, raw)
        g, rows = t["g"][0].as_py(), []
        for b, lo, hi in _slices(_bucket_of(key, buckets)):
            rows.append((g, b, key[lo:hi].tobytes() + np.minimum(counts[lo:hi], 65535).astype(np.uint16).tobytes() + several[lo:hi].tobytes()))
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["g", "bucket", "data"])

    @_releasing
    def answered(t: pa.Table) -> pa.Table:
        blobs = t["data"].to_pylist()
        sizes = [len(b) // 11 for b in blobs]
        key = np.concatenate([np.frombuffer(b, U, n) for b, n in zip(blobs, sizes, strict=True)])
        count = np.concatenate([np.frombuffer(b, np.uint16, n, 8 * n) for b, n in zip(blobs, sizes, strict=True)])
        several = np.concatenate([np.frombuffer(b, bool, n, 10 * n) for b, n in zip(blobs, sizes, strict=True)])
        _, inverse, groups = np.unique(key, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, count, len(groups))
        again = (groups > 1) | (np.bincount(inverse, several, len(groups)) > 0)
        answer = np.where(again, np.where(total > HOT, 2, 1), 0).astype(np.uint8)[inverse]
        cut = np.cumsum([0, *sizes])
        return pa.table([t["g"], t["bucket"], pa.array([answer[cut[i] : cut[i + 1]].tobytes() for i in range(len(blobs))], pa.binary())], names=["g", "bucket", "data"])

    anchors = texts.select("g", "row", "doc", "text").groupBy("g").applyInArrow(sent, REPLY)
    return anchors.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answered, REPLY)


def _snippets(kind: Kind, docs: np.ndarray, texts: list[bytes], answer: np.ndarray, contents: bool = True) -> tuple[list[Step], dict]:
    """The steps, and the distinct snippets around repeated anchors.

    A snippet holds the symbols from the first window to the end of the last, at fixed places around the anchor (those
    outside are 0; m, if contents are wanted), and the owner (text, then start of the anchor if starts count) that is
    the least of its copies. Runs at hot anchors give a snippet for each window, which then starts at the anchor's
    place. Copies are found by their hashes and compared symbol by symbol where contents are wanted."""
    steps = list(kind.steps(texts))
    uniques = np.unique(np.concatenate([s.key for s in steps])) if steps else np.zeros(0, U)
    found, at = [], 0
    for s in steps:
        flag = answer[np.searchsorted(uniques, s.key)]
        for hot in (False, True):
            runs = np.flatnonzero(flag == 1 + hot)
            if not len(runs):
                continue
            if hot:
                n = s.last[runs] - s.first[runs] + 1
                runs = np.repeat(runs, n)
                anchor = np.arange(len(runs)) - np.repeat(np.cumsum(n) - n, n) + s.first[runs]
                first = last = anchor
            else:
                anchor, first, last = s.anchor[runs], s.first[runs], s.last[runs]
            extent = np.stack([anchor - first, anchor - last], 1).astype(np.int16)
            same = _content_hashes(kind, s, first, last, extent)
            start = anchor - s.bounds[s.text[runs]] + s.offset if kind.own_starts else np.zeros(len(runs), np.int64)
            found.append((same, docs[s.text[runs] + s.base], start, extent, same if hot else s.key[runs], anchor + at))
        at += len(s.symbols)
    if not found:
        return steps, {}
    same, owner, start, extent, key, anchor = (np.concatenate([f[i] for f in found]) for i in range(6))
    order = np.lexsort((start, owner, same))
    new = np.concatenate([[True], same[order][1:] != same[order][:-1]])
    rep = order[new]
    by = np.argsort(key[rep], kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    member = np.empty(len(order), np.int64)
    member[order] = rank[np.cumsum(new) - 1]
    rep, m = rep[by], None
    if contents:
        whole = np.concatenate([s.symbols for s in steps])
        m = _around(kind, whole, anchor[rep], extent[rep])
        copies, rows = np.flatnonzero(rep[member] != np.arange(len(member))), max(1, CELLS // m.shape[1])
        for lo in range(0, len(copies), rows):
            part = copies[lo : lo + rows]
            if (_around(kind, whole, anchor[part], extent[part]) != m[member[part]]).any() or (extent[part] != extent[rep[member[part]]]).any():
                raise RuntimeError("two passages share a 64-bit hash")
    return steps, {"key": key[rep], "m": m, "owner": owner[rep], "start": start[rep], "extent": extent[rep], "member": member, "of_owner": owner, "of_start": start, "anchor": anchor, "of_extent": extent}


def _around(kind: Kind, symbols: np.ndarray, anchor: np.ndarray, extent: np.ndarray) -> np.ndarray:
    """A row for each run: the symbols of its windows at fixed places around the anchor, 0 outside of them."""
    left = kind.size - kind.gram
    at = np.arange(left + kind.size)
    out, rows = np.zeros((len(anchor), len(at)), symbols.dtype), max(1, CELLS // len(at))
    for lo in range(0, len(anchor), rows):
        part = slice(lo, lo + rows)
        inside = (at >= left - extent[part, :1]) & (at < left - extent[part, 1:] + kind.size)
        out[part] = np.where(inside, symbols[np.clip(anchor[part, None] - left + at, 0, len(symbols) - 1)], 0)
    return out


def _window_answers(kind: Kind, texts: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """(g, bucket, data): for each distinct snippet of a group in order, the bits of its windows."""

    @_releasing_both
    def sent(t: pa.Table, replies: pa.Table) -> pa.Table:
        docs, _, raw, _ = _of_group(t)
        answer = _joined(replies)
        rows = []
        if len(raw):
            g, x = t["g"][0].as_py(), _snippets(kind, docs, raw, answer)[1]
            if x:
                rows = [(g, b, kind.packed(x, lo, hi)) for b, lo, hi in _slices(_bucket_of(x["key"], buckets))]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["g", "bucket", "data"])

    @_releasing
    def answered(t: pa.Table) -> pa.Table:
        bits = kind.found(t["data"].to_pylist())
        return pa.table([t["g"], t["bucket"], pa.array([np.packbits(b, axis=1).tobytes() for b in bits], pa.binary())], names=["g", "bucket", "data"])

    snippets = texts.select("g", "row", "doc", "text").groupBy("g").cogroup(anchors.groupBy("g")).applyInArrow(sent, REPLY)
    return snippets.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answered, REPLY)


def _joined(replies: pa.Table) -> np.ndarray:
    order = np.argsort(replies["bucket"].to_numpy(), kind="stable")
    blobs = replies["data"].to_pylist()
    return np.frombuffer(b"".join(blobs[i] for i in order), np.uint8)


def covered(kind: Kind, docs: DataFrame, id_col: str, text_col: str, finish, schema: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """finish(table of a group's rows, its texts, for each text the mask of its symbols that lie in a repeat), by group.

    The second result is the name of the table of texts, to be dropped when the first has been written."""
    spark = docs.sparkSession
    texts, name, n_bytes = stored(docs, id_col, text_col, keep)
    parts = partitions_for(spark, 3 * n_bytes, 2 * BUCKET_BYTES)
    anchors = saved(_repeated_anchors(kind, texts, parts))
    answers = saved(_window_answers(kind, texts, anchors, parts))
    both = anchors.select("g", F.lit(0).alias("step"), "bucket", "data").union(answers.select("g", F.lit(1).alias("step"), "bucket", "data"))

    @_releasing_both
    def of(t: pa.Table, replies: pa.Table) -> pa.Table:
        owners, _, raw, t = _of_group(t)
        step = replies["step"].to_numpy()
        answer = _joined(replies.filter(pa.array(step == 0)))
        steps, x = _snippets(kind, owners, raw, answer, contents=False)
        edge = np.zeros(sum(len(s.symbols) for s in steps) + kind.size + 1, np.int32)
        if x:
            width = -(-(kind.size - kind.gram + 1) // 8)
            bits = np.unpackbits(_joined(replies.filter(pa.array(step == 1))).reshape(-1, width), axis=1)[:, : kind.size - kind.gram + 1].astype(bool)
            hit = bits[x["member"]]
            later = (x["of_owner"] > x["owner"][x["member"]]) | ((x["of_owner"] == x["owner"][x["member"]]) & (x["of_start"] > x["start"][x["member"]]))
            hit[later] = True
            offset = np.arange(hit.shape[1])
            hit &= (offset <= x["of_extent"][:, :1]) & (offset >= x["of_extent"][:, 1:])
            run, back = np.nonzero(hit)
            place = x["anchor"][run] - back
            edge += np.bincount(place, minlength=len(edge)).astype(np.int32)
            edge -= np.bincount(place + kind.size, minlength=len(edge)).astype(np.int32)
        inside, masks, at = np.cumsum(edge) > 0, [], 0
        for s in steps:
            for i in range(len(s.bounds) - 1):
                mask = inside[at + s.bounds[i] : at + s.bounds[i + 1]]
                if s.offset:
                    masks[-1][-1][-s.overlap :] |= mask[: s.overlap]
                    masks[-1].append(mask[s.overlap :])
                else:
                    masks.append([mask])
            at += len(s.symbols)
        return finish(t, raw, [np.concatenate(m) for m in masks])

    cols = ["g", "row", "doc", "text", *[f"keep_{c}" for c in keep]]

    return texts.select(*cols).groupBy("g").cogroup(both.groupBy("g")).applyInArrow(of, schema), name
