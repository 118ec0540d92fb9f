"""What makes two texts near copies: sets of word shingles with a Jaccard similarity of at least a limit.

The candidates come from SimHash (see simhash) as connected groups. Each set travels once, to its group, and all pairs of
a group are compared there on the whole sets, in blocks where the group is large; what leaves is a tree of the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, sorted_groups

#: Bytes of sets of a block of a group, and sets from the first to the second number. Shingles of up to FEW sets are
#: counted pair by pair, others as a matrix.
BLOCK_BYTES, BLOCK, FULL, FEW, COLUMNS = 16 << 20, 512, 2048, 16, 4096
MARKS, MARK_BLOCK = 1 << 23, 1 << 15  # Spark's bitmaps hold 2**15 bits
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(s: np.ndarray) -> np.ndarray:
    s = (s ^ (s >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    s = (s ^ (s >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return s ^ (s >> np.uint64(31))


TURNS = _mixed(np.arange(1, 65, dtype=np.uint64) * ODD) | np.uint64(1)


class _Words(dict):
    """Hashes of words, each made once while the table is small."""

    def __missing__(self, w: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 200_000:
            self.clear()
        self[w] = h = xxh64_intdigest(w, 42)
        return h


def shingles(text: bytes, seen: dict, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a text of fewer words is one shingle."""
    w = text.lower().split()
    h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
    width = min(words, len(w))
    if not width:
        return h
    s = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        s = s * ODD + h[i : len(h) - width + 1 + i]
    return np.unique(_mixed(s))


def sketch(s: np.ndarray) -> int:
    """One bit of the least hash of a set under each of 64 hashes, as a signed number; sets of similarity j differ in some 32 (1 - j) bits."""
    least = np.full(64, 2**64 - 1, np.uint64)
    for lo in range(0, len(s), 1024):
        least = np.minimum(least, (s[lo : lo + 1024, None] * TURNS).min(0))
    return int.from_bytes(np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(bool)).tobytes(), "big", signed=True)


def set_hash(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(s.tobytes(), 42)).view(np.int64))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def _marks(ids: DataFrame) -> np.ndarray:
    """A table of fixed size with a mark for each id, modulo its size; an id without a mark isn't among them."""
    at = F.pmod(F.col("id"), F.lit(MARKS)) + 1
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((MARKS // MARK_BLOCK, MARK_BLOCK // 8), np.uint8)
    for r in rows.collect():
        out[r["block"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common, and on the diagonal how many each holds."""
    m, owner = len(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    order = np.lexsort((owner, column))
    column, owner, start = column[order], owner[order], np.cumsum(many) - many
    for k in range(2, FEW + 1):
        at = start[many == k]
        for i in range(k if len(at) else 0):
            for j in range(i + 1, k):
                out += np.bincount(owner[at + i] * m + owner[at + j], minlength=m * m).reshape(m, m)
    out += out.T
    often = np.flatnonzero(many > FEW)
    rank = np.full(len(many), -1)
    rank[often] = np.arange(len(often))
    kept = rank[column] >= 0
    place, owner = rank[column][kept], owner[kept]
    for lo in range(0, len(often), COLUMNS):
        a, b = np.searchsorted(place, [lo, lo + COLUMNS])
        x = np.zeros((m, COLUMNS), np.float32)
        x[owner[a:b], place[a:b] - lo] = 1
        out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(u, v): trees that join the sets of a block pair whose similarity reaches the limit."""
    for t, starts in sorted_groups(batches, ["comp", "a", "b"]):
        names, raw, found = t.column("h").to_numpy(), t.column("shingles").to_pylist(), []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            common = shared_counts([np.frombuffer(s, np.uint64) for s in raw[lo:hi]])
            n = np.diagonal(common)
            near = common >= similarity / (1 + similarity) * (n[:, None] + n) - 1e-3  # |A & B| >= s |A | B|
            part = np.arange(hi - lo)
            while True:
                least = np.where(near, part, hi - lo).min(1)
                if (least == part).all():
                    break
                part = least
            at = np.flatnonzero(part != np.arange(hi - lo))
            found.append(np.stack([names[lo:hi][at], names[lo:hi][part[at]]], 1))
        if found and len(e := np.concatenate(found)):
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])


def verified(groups: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (u, v) inside groups (h, comp) of set hashes; nodes (h, id, n) has the id of a text and the size of each set.

    Texts are read again, and sets made of those that may be in a group, so that only these are moved."""
    members = saved(nodes.join(groups, "h"))
    marks = texts.sparkSession.sparkContext.broadcast(_marks(members.select("id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marked = _Words(), marks.value
        for whole in batches:
            at = whole.column(0).to_numpy() % MARKS
            whole = whole.filter(pa.array((marked[at >> 3] >> (at & 7) & 1).astype(bool)))
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                found = [shingles(t.as_py(), seen, words) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_hash(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "h", "shingles"])

    size = members.groupBy("comp").agg(F.sum(8 * F.col("n").cast("long")).alias("size"), F.count(F.lit(1)).alias("many"))
    each = F.least(F.greatest(F.col("many") / 32, F.lit(BLOCK)), F.lit(FULL))
    blocks = size.select("comp", F.ceil(F.greatest(F.col("size") / BLOCK_BYTES, F.col("many") / each)).cast("int").alias("blocks"))
    placed = saved(members.join(blocks, "comp").select("id", "h", "comp", "blocks"))
    own = texts.mapInArrow(sets, "id long, h long, shingles binary").join(placed, ["id", "h"]).dropDuplicates(["id", "h"])  # as the join deals them
    x = own.withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = x.select("comp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "h", "shingles")
    by = ["comp", "a", "b"]
    return saved(pairs.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda b: _links(b, similarity), "u long, v long"))
