"""SimHash near-duplicates with covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint over its word shingles. Fingerprints link when at most two bits differ.
A covering family of bit masks finds every such pair: bit i carries a non-zero vector m(i) of three bits, and the
mask of vector x keeps the bits with <m(i), x> = 1. Two differing bits span at most two of three dimensions, so some
non-zero x is orthogonal to both, and under its mask the two fingerprints are equal. Two independent families are
used together (7 x 7 masks): a bucket then fixes at least 51 of the 64 bits, so that it holds at most 2**13 fingerprints however
large a group of copies is. Equal fingerprints are one row before any bucket is made.

Near copies by shingle sets differ in more bits. For them the bits are halved: of up to 2 r + 1 differing bits one half
has at most r, and vectors m(i) of r + 1 bits cover these in 2**(r + 1) - 1 masks. Each bucket reports a tree of the
fingerprints that are near; the connected groups are candidates, and near_copies compares their sets. One in a million
pairs of unrelated texts is within that radius, so beyond a million texts chance alone would connect nearly all of them to
one group: a second sketch, of the shingle sets, must be near as well."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .shared import components, joined, partitions_for, saved, sorted_groups

RADIUS = 2
#: Differing bits, of a half and of the whole, for near copies. Sets of five-word shingles of similarity 0.8 have
#: fingerprints over three-word shingles that differ in some 8 bits.
HALF_RADIUS, NEAR_RADIUS, EVERY = 5, 13, 16
#: Differing bits of sketches: 6.4 are expected at similarity 0.8, and one of some 100 000 such pairs has over 18; of unrelated
#: pairs one of some 3200 has no more. Up to so many rows of a bucket are compared pair by pair.
SKETCH_RADIUS, PAIRED = 18, 64


def covering_masks() -> list[int]:
    """The 49 masks, as signed 64-bit numbers."""
    first = [1 + i % 7 for i in range(64)]
    second = [1 + (i // 7 if i < 49 else 3 * i + 5 * (i // 7)) % 7 for i in range(64)]  # all 49 pairs once, the rest spread over them
    odd = lambda a, b: bin(a & b).count("1") % 2
    masks = [sum(1 << i for i in range(64) if odd(first[i], x) or odd(second[i], y)) for x in range(1, 8) for y in range(1, 8)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint(text: bytes, words: int = 3) -> int:
    """The signed 64-bit fingerprint of a text: bit b is set if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return 0
    if len(w) < words:
        hashes = np.array([xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
        hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(w) - words + 1)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(bits), 255):
        counts += bits[i : i + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows (id, fp) for each row; a null or empty text has fingerprint 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"", words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(of, "id long, fp long")


def _forest(fps: np.ndarray, ids: np.ndarray, radius: int, sketches: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join what is linked inside one bucket: a tree for each linked part, not all its pairs.

    Sketches, if given, must be near as well."""
    left, edges = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if sketches is not None:
                near &= np.bitwise_count(sketches[left] ^ sketches[at]) <= SKETCH_RADIUS
            if near.any():
                found = left[near]
                edges += [(int(ids[at]), int(ids[x])) for x in found]
                queue += list(found)
                left = left[~near]
    return edges


def bucket_edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between the representatives of distinct fingerprints (fp, rep)."""
    keys = F.explode(F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks())]))
    rows = distinct.select(keys.alias("k"), "fp", "rep").select("k.t", "k.key", "fp", "rep")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_groups(batches, ["t", "key"]):
            fps, ids = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy()
            size = np.diff(starts)
            two = starts[:-1][size == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
            u, v = ids[two[near]], ids[two[near] + 1]
            more = [e for s, n in zip(starts[:-1][size > 2], size[size > 2], strict=True) for e in _forest(fps[s : s + n], ids[s : s + n], radius)]
            if more:
                x = np.array(more, np.int64)
                u, v = np.concatenate([u, x[:, 0]]), np.concatenate([v, x[:, 1]])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    parts = partitions_for(distinct.sparkSession, 25 * len(covering_masks()) * distinct.count(), 64 << 20)
    return rows.repartition(parts, "t", "key").sortWithinPartitions("t", "key").mapInArrow(of, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row (id, fp, component) for each row of docs; component is the smallest id reachable over links.

    Null texts count as empty, empty texts have fingerprint 0 and link like any other; rows that repeat are
    returned as often as they come; rows without an id take part under their fingerprint but are no
    representative. Other columns of docs are not looked at. An empty table gives an empty result."""
    fps = saved(fingerprints(docs, id_col, text_col, words))
    distinct = saved(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    found = components(bucket_edges(distinct.where("rep is not null")))
    named = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return joined(fps, named, "fp", "id").select("id", "fp", "component")


def half_masks(radius: int = HALF_RADIUS) -> list[int]:
    """Masks, as unsigned numbers, of which one leaves out all differing bits of any pair with at most radius in a half."""
    top = 1 << radius  # m(i) = top + i: every vector but top itself keeps half of the 32 bits
    kept = [sum(1 << i for i in range(32) if bin((top + i % top) & x).count("1") % 2) for x in range(1, 2 * top)]
    return kept + [m << 32 for m in kept]


def near_edges(nodes: DataFrame, n: int, family: list[int] | None = None) -> DataFrame:
    """Edges (u, v) that join nodes (fp, h) of one bucket whose fingerprints differ in at most NEAR_RADIUS bits.

    Rows with one h are one node. A column sketch, if there is one, must be within SKETCH_RADIUS bits as well. family holds
    the masks; all of half_masks() by default."""
    masks = [m - (1 << 64) if m >> 63 else m for m in family or half_masks()]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(masks, np.int64)
        turn = np.uint64(0x9E3779B97F4A7C15)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                fp = b.column(0).to_numpy()
                key = ((fp[:, None] & at).view(np.uint64) + np.arange(1, len(at) + 1, dtype=np.uint64)) * turn
                key = ((key ^ (key >> np.uint64(32))) * turn >> np.uint64(32)).astype(np.uint32)  # half a hash: buckets that share one are compared in vain
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int32).ravel()), *(pa.array(np.repeat(b.column(i).to_numpy(), len(at))) for i in range(3))], ["key", "fp", "h", "sketch"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_groups(batches, ["key"]):
            fp, h, sketch = t.column("fp").to_numpy().view(np.uint64), t.column("h").to_numpy(), t.column("sketch").to_numpy().view(np.uint64)
            size, found, by = np.diff(starts), [], 1
            after = np.repeat(np.where(size <= PAIRED, starts[1:], 0), size) - np.arange(1, len(h) + 1)  # rows of the bucket that follow
            a = np.flatnonzero(after >= by)
            while len(a):
                x = a[np.bitwise_count(fp[a] ^ fp[a + by]) <= NEAR_RADIUS]
                x = x[(np.bitwise_count(sketch[x] ^ sketch[x + by]) <= SKETCH_RADIUS) & (h[x] != h[x + by])]
                found.append(np.stack([h[x], h[x + by]], 1))
                by += 1
                a = a[after[a] >= by]
            for s, k in zip(starts[:-1][size > PAIRED], size[size > PAIRED], strict=True):
                if h[s] != h[s + k - 1]:  # sorted
                    found.append(np.array([e for e in _forest(fp[s : s + k], h[s : s + k], NEAR_RADIUS, sketch[s : s + k]) if e[0] != e[1]], np.int64).reshape(-1, 2))
            if found and len(e := np.unique(np.concatenate(found), axis=0)):
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])

    parts = partitions_for(nodes.sparkSession, 28 * len(masks) * n, 64 << 20)
    sketch = "sketch" if "sketch" in nodes.columns else F.lit(0).cast("long").alias("sketch")
    rows = nodes.select("fp", "h", sketch).mapInArrow(placed, "key int, fp long, h long, sketch long")
    return rows.repartition(parts, "key").sortWithinPartitions("key", "h").mapInArrow(of, "u long, v long")  # the least h of a bucket is its root, so that buckets agree


def _candidate_groups(nodes: DataFrame, n: int) -> DataFrame:
    """(h, comp): the nodes (h, fp, sketch) that edges connect with others, by group.

    A few masks come first. What they connect is one node for all masks, so that a large group of near copies, which meets
    in nearly every bucket, isn't connected anew in each."""
    first = components(near_edges(nodes, n, half_masks()[::EVERY]))
    labelled = saved(nodes.join(first, nodes["h"] == first["node"], "left").select("h", "fp", "sketch", F.coalesce("component", "h").alias("label"), F.col("component").isNotNull().alias("met")))
    rest = components(near_edges(labelled.select("fp", "sketch", F.col("label").alias("h")).distinct(), n))
    found = labelled.join(rest, labelled["label"] == rest["node"], "left").where("met or component is not null")
    return saved(found.select("h", F.coalesce("component", "label").alias("comp")))


def _near_rows(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h) for each row with an id, h a hash of its set; and (h, least, c): of each set the least (id, t), t a hash of the text, and its group."""
    texts = near_copies.texts_of(docs, id_col, text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = near_copies._Words()
        for b in batches:
            raw = b.column(1).to_pylist()
            sets = [near_copies.shingles(t, seen, words) for t in raw]
            cols = [[fingerprint(t) for t in raw], [near_copies.set_hash(s) for s in sets], [near_copies.sketch(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, pa.int64()) for c in cols), pa.array([len(s) for s in sets], pa.int32())], ["id", "t", "fp", "h", "sketch", "n"])

    rows = saved(texts.withColumn("t", F.xxhash64("text")).mapInArrow(of, "id long, t long, fp long, h long, sketch long, n int"))
    nodes = saved(rows.groupBy("h").agg(F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min(F.struct("id", "t")).alias("least"), F.max("n").alias("n")))
    groups = _candidate_groups(nodes, nodes.count())
    links = components(near_copies.verified(groups, texts, nodes.select("h", F.col("least.id").alias("id"), "n"), words, similarity))
    owners = nodes.join(links, F.col("h") == F.col("node"), "left").select("h", "least", F.coalesce("component", "h").alias("c"))
    return rows.select("id", "h"), saved(owners)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row (id, component) for each row of docs with an id: the smallest id reachable over near copies.

    Texts link if their sets of shingles of so many words, in lower case, have at least that Jaccard similarity and
    their fingerprints connect. A null text counts as empty, and empty texts are copies of each other; a text of fewer
    words is one shingle. Rows that repeat are copies; texts are whole, however long. Other columns of docs are not
    looked at. An empty table gives an empty result."""
    rows, owners = _near_rows(docs, id_col, text_col, words, similarity)
    named = joined(owners.select("h", "c"), owners.groupBy("c").agg(F.min("least.id").alias("component")), "c", "h").select("h", "component")
    return joined(rows, named, "h", "id").select("id", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay: one of each group of near copies, that with the smallest id.

    Rows with one id and different texts are rows like others: each stays unless it is a near copy of an earlier one. Of
    equal ids in a group the one whose text has the least hash stays, of rows with equal ids and texts any one; rows
    without an id stay."""
    _, owners = _near_rows(docs, id_col, text_col, words, similarity)
    found = owners.groupBy("c").agg(F.min("least").alias("least")).select(F.col("least.id").alias("_kept_id"), F.col("least.t").alias("_kept_text"))
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    kept = docs.join(found, (docs[id_col] == found["_kept_id"]) & (mark == found["_kept_text"]), "left_semi")
    name = "_".join([*docs.columns, "mark"])  # no column's name
    return kept.withColumn(name, mark).dropDuplicates([id_col, name]).drop(name).unionByName(docs.where(F.col(id_col).isNull()))
