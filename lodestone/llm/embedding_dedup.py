"""Near-duplicate embeddings by lattice hashing.

1. Vectors are rotated at random, and each table takes eight of the rotated axes and decodes them to points of the E8
   lattice. A vector is stored under the lattice point that it decodes to, and looks for others there and in the next
   nearest lattice points. What travels to the cells isn't the vector but 128 signs of it under random projections:
   two that differ in at most SIGNS of them are candidates. Cells report trees of candidates, never all pairs; a cell
   of very many rows is split into blocks.
2. Connected candidates form groups. Only vectors of groups with several members travel, once each, and every pair of a
   group is verified by its cosine in double precision, in blocks where the group is large. So a pair that no cell
   found still counts if others join it.

At the defaults a pair at exactly the threshold shares a cell with probability 0.9998 and is within SIGNS with
probability 0.999999 (binomial); test_embeddings measures recall against brute force."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import HUBS, components, joined, partitions_for, saved, sorted_groups

TABLES, PROBES, CELL, SEED = 4, 4, 1.15, 42
#: Most signs of 128 in which candidates differ, at a threshold of 0.98; some five standard deviations above the mean.
SIGNS = 22
#: Rows of a cell that are compared in place; vectors of a block of a group, of which there are BLOCKS until blocks are full.
CELL_ROWS, BLOCK, BLOCKS, FULL, TILE = 20_000, 256, 32, 1 << 16, 512
U = np.uint64
#: Which of the four least certain coordinates are rounded the other way, by the parity of the plain rounding.
FLIPS = (((), (0,)), ((0, 1), (1,)), ((0, 2), (2,)), ((1, 2), (3,)), ((0, 3), (0, 1, 2)))


def decode(x: np.ndarray, n: int) -> np.ndarray:
    """The n nearest E8 points of each row of x, doubled so that they are whole numbers; shape (rows, n, 8).

    E8 is D8 (whole numbers with an even sum) and D8 shifted by one half; candidates come from both."""
    points, dist, at = [], [], np.arange(len(x))
    for shift in (0.0, 0.5):
        y = x - shift
        r = np.rint(y)
        e = y - r
        unsure = np.argsort(-np.abs(e), axis=1, kind="stable")[:, :4]
        odd = r.sum(1).astype(np.int64) % 2 == 1
        way = np.where(e >= 0, 1.0, -1.0)
        for even_flips, odd_flips in FLIPS:
            c, d = r.copy(), (e**2).sum(1)
            for k in range(4):
                flip, i = np.where(odd, k in odd_flips, k in even_flips), unsure[:, k]
                c[at, i] += flip * way[at, i]
                d += flip * (1 - 2 * np.abs(e[at, i]))
            points.append(c + shift)
            dist.append(d)
    best = np.argsort(np.stack(dist, 1), axis=1, kind="stable")[:, :n]
    return np.rint(2 * np.take_along_axis(np.stack(points, 1), best[:, :, None], 1)).astype(np.int64)


def cells(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """64-bit cell ids of unit vectors, shape (rows, TABLES, PROBES); the first of each table is the vector's own."""
    d = vectors.shape[1]
    width = max(d, 8 * TABLES)
    turn = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, width)))[0][:d, : 8 * TABLES]
    size = CELL * np.sqrt(max(2 - 2 * threshold, 1e-6)) * np.sqrt(64 / width)
    out, weights = np.empty((len(vectors), TABLES, PROBES), np.int64), np.random.default_rng(SEED + 1).integers(1, 2**63, 8, np.int64) | 1
    for t in range(TABLES):
        points = decode((vectors @ turn[:, 8 * t : 8 * t + 8]) / size, PROBES)
        h = (points * weights).sum(2).view(U) + U((t + 1) * 0x9E3779B97F4A7C15 % 2**64)
        out[:, t] = _mixed(h).view(np.int64)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def signs(vectors: np.ndarray) -> np.ndarray:
    """128 signs of random projections of each row, as two 64-bit numbers.

    Whole numbers only, so that tasks on different machines give a vector the same signs."""
    top = np.abs(vectors).max(1)[:, None]
    turn = np.rint(np.random.default_rng(SEED + 2).normal(size=(vectors.shape[1], 128)) * 256)
    return np.packbits(np.rint(vectors / top * 2.0**20) @ turn > 0, axis=1).view(np.int64)


def most_signs(threshold: float) -> int:
    """SIGNS for another threshold: as many standard deviations above the mean number of differing signs."""
    p = [np.arccos(min(x, 1.0)) / np.pi for x in (0.98, threshold)]
    mean, spread = 128 * np.array(p), np.sqrt(128 * np.array(p) * (1 - np.array(p)))
    return int(np.ceil(mean[1] + (SIGNS - mean[0]) / spread[0] * spread[1])) if threshold < 1 else 0


class _Good:
    """The rows of a batch (id, label, vec) that can link, by their number of components, with equal ones once."""

    def __init__(self, b: pa.RecordBatch):
        ids, labels, lists = b.column(0), b.column(1), b.column(2)
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        count = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[ends] - c[begins]
        self.ok = (sizes > 0) & (count(~np.isfinite(flat)) == 0) & (count(flat != 0) > 0)
        self.ok &= ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
        self.ids, self.labels = (x.fill_null(0).to_numpy() for x in (ids, labels))
        self.sizes, self.begins, self.flat, self.lists = sizes, begins, flat, lists

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(rows, vectors, members): the first row of each set of equal rows, its vector, and the rows of the set."""
        for d in np.unique(self.sizes[self.ok]):
            at = np.flatnonzero(self.ok & (self.sizes == d))
            v = self.flat[self.begins[at][:, None] + np.arange(d)]
            whole = np.concatenate([v.view(np.int64), self.labels[at][:, None]], axis=1)
            _, first, inverse = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            yield at[first], v[first], np.split(at[order], np.flatnonzero(np.diff(inverse[order])) + 1)


def _placed(rows: DataFrame, threshold: float) -> DataFrame:
    """(cell, role, s0, s1): the cell that a vector is stored in (role 0) and those that it only looks into (role 1)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                good = _Good(whole.slice(lo, 2000))
                for at, v, _ in good.groups():
                    s = signs(v)
                    v = v / np.abs(v).max(1)[:, None]
                    v /= np.linalg.norm(v, axis=1)[:, None]
                    own = good.labels[at].astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + U(v.shape[1])
                    cell = _mixed(cells(v, threshold).view(U) ^ _mixed(own)[:, None, None]).view(np.int64)
                    role = np.broadcast_to((np.arange(PROBES) > 0).astype(np.int8), cell.shape)
                    cols = [cell.ravel(), role.ravel(), *(np.repeat(s[:, i], TABLES * PROBES) for i in (0, 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["cell", "role", "s0", "s1"])

    return rows.mapInArrow(of, "cell long, role byte, s0 long, s1 long")


def _trees(role: np.ndarray, s0: np.ndarray, s1: np.ndarray, most: int) -> list[np.ndarray]:
    """Edges (u, v) between the signs of a cell's rows that join all candidates: a tree for each tile, not its pairs."""
    found, stored = [], np.flatnonzero(role == 0)
    for lo in range(0, len(stored), TILE):
        s = stored[lo : lo + TILE]
        for q in np.array_split(np.arange(len(role)), -(-len(role) // (16 * TILE))):
            near = np.bitwise_count(s0[q][:, None] ^ s0[s][None, :]) + np.bitwise_count(s1[q][:, None] ^ s1[s][None, :]) <= most
            near &= s0[q][:, None] != s0[s][None, :]
            if near.any():
                found += _joined_up(near, s0[q], s0[s])
    return found


def _joined_up(near: np.ndarray, q: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
    """Edges that connect what near connects: each of q and s with the first of s in its part."""
    part, none = np.arange(len(s)), len(s)
    while True:
        of_q = np.where(near, part, none).min(1)
        now = np.minimum(part, np.where(near, of_q[:, None], none).min(0))
        if (now == part).all():
            break
        part = now
    linked = of_q < none
    far = part != np.arange(len(s))
    return [np.stack([q[linked], s[of_q[linked]]], 1), np.stack([s[far], s[part[far]]], 1)]


def _candidates(placed: DataFrame, threshold: float, n: int) -> DataFrame:
    """Edges (u, v) between first signs (s0) of vectors that share a cell and differ in few signs."""
    most = most_signs(threshold)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_groups(batches, ["cell"], CELL_ROWS):
            cell, role, s0, s1 = (t.column(c).to_numpy() for c in ("cell", "role", "s0", "s1"))
            if starts is None:  # for blocks
                yield pa.RecordBatch.from_arrays([pa.nulls(len(cell), pa.int64()), pa.nulls(len(cell), pa.int64()), *(pa.array(x) for x in (cell, role, s0, s1))], names)
                continue
            found, size, x = [], np.diff(starts), [a.view(U) for a in (s0, s1)]
            near = lambda a, b: (np.bitwise_count(x[0][a] ^ x[0][b]) + np.bitwise_count(x[1][a] ^ x[1][b]) <= most) & (s0[a] != s0[b]) & ((role[a] == 0) | (role[b] == 0))
            small = np.repeat(np.where(size <= 16, np.arange(len(size)), -1), size)
            for by in range(1, min(16, int(size.max()))):
                a = np.flatnonzero((small[by:] == small[:-by]) & (small[by:] >= 0))
                a = a[near(a, a + by)]
                found.append(np.stack([s0[a], s0[a + by]], 1))
            for lo, k in zip(starts[:-1][size > 16].tolist(), size[size > 16].tolist(), strict=True):
                at = slice(lo, lo + k)
                found += [e.view(np.int64) for e in _trees(role[at], x[0][at], x[1][at], most)]
            e = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            if len(e):
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), *(pa.nulls(len(e), k) for k in (pa.int64(), pa.int8(), pa.int64(), pa.int64()))], names)

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_groups(batches, ["cell", "a", "b"]):
            role, side, s0, s1 = (t.column(c).to_numpy() for c in ("role", "side", "s0", "s1"))
            x = [a.view(U) for a in (s0, s1)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                q, found = np.flatnonzero(side[lo:hi] != 1) + lo, []
                stored = np.flatnonzero((side[lo:hi] != 0) & (role[lo:hi] == 0)) + lo
                for k in range(0, len(stored), TILE):
                    s = stored[k : k + TILE]
                    for part in np.array_split(q, -(-len(q) // (16 * TILE)) or 1):
                        near = np.bitwise_count(x[0][part][:, None] ^ x[0][s]) + np.bitwise_count(x[1][part][:, None] ^ x[1][s]) <= most
                        near &= s0[part][:, None] != s0[s]
                        if near.any():
                            found += _joined_up(near, s0[part], s0[s])
                if found:
                    e = np.unique(np.concatenate(found), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])

    names = ["u", "v", "cell", "role", "s0", "s1"]
    parts = partitions_for(placed.sparkSession, 32 * TABLES * PROBES * n, 64 << 20)
    found = saved(placed.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(of, "u long, v long, cell long, role byte, s0 long, s1 long"))
    large = found.where("cell is not null").select("cell", "role", "s0", "s1")
    split = large.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / max(CELL_ROWS, TABLES * PROBES * n // HUBS)).cast("int").alias("blocks"))
    pairs = _block_pairs(joined(large, split, "cell", "s0"), F.xxhash64("s0", "s1", "role"))
    more = pairs.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b").select("cell", "a", "b", "role", "side", "s0", "s1").mapInArrow(of_blocks, "u long, v long")
    return found.where("u is not null").select("u", "v").union(more)


def _block_pairs(rows: DataFrame, spread) -> DataFrame:
    """Each row of rows with column blocks in every pair (a, b), a <= b, of its own block and another.

    side is 0 in the first block of a pair, 1 in the second, and 2 where both are the row's own."""
    own = F.pmod(spread, F.col("blocks")).cast("int")
    x = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("byte")
    return x.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other"), "side": side}).drop("own", "other", "blocks")


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, n, root, ids): how many vectors each node of a block pair links to there, and the first node of its part."""
    for t, starts in sorted_groups(batches, ["comp", "a", "b"]):
        sides, labels, nodes = (t.column(c).to_numpy() for c in ("side", "label", "node"))
        weights = t.column("ids").combine_chunks().value_lengths().to_numpy()
        lists = t.column("vec").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        begins = np.cumsum(sizes) - sizes
        n, root = np.zeros(t.num_rows, np.int64), nodes.copy()
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo == 1:
                continue
            kind = np.stack([labels[lo:hi], sizes[lo:hi]], 1)
            for label, d in np.unique(kind, axis=0):
                at = np.flatnonzero((kind == (label, d)).all(1)) + lo
                v = flat[begins[at][:, None] + np.arange(d)].astype(np.float64)
                v /= np.abs(v).max(1)[:, None]
                v /= np.linalg.norm(v, axis=1)[:, None]
                q, s = np.flatnonzero(sides[at] != 1), np.flatnonzero(sides[at] != 0)
                edges = []
                for k in range(0, len(s), TILE):
                    part = s[k : k + TILE]
                    near = (v[q] @ v[part].T >= threshold) & (nodes[at[q]][:, None] != nodes[at[part]])
                    if near.any():
                        n[at[q]] += near @ weights[at[part]]
                        if sides[at[0]] != 2:  # two blocks: the other one counts too
                            n[at[part]] += weights[at[q]] @ near
                        edges += _joined_up(near, q, part)
                if edges:
                    _hook(root, nodes, at, np.concatenate(edges))
        n += np.where(sides == 2, weights - 1, 0)
        keep = (sides == 2) | (n > 0) | (root != nodes)
        ids = pa.compute.if_else(pa.array(sides == 2), t.column("ids").combine_chunks(), pa.scalar(None, t.column("ids").type))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n), pa.array(root), ids], ["node", "n", "root", "ids"]).filter(pa.array(keep))


def _hook(root: np.ndarray, nodes: np.ndarray, at: np.ndarray, edges: np.ndarray) -> None:
    """Sets root of the rows at to the least node that edges (places in at) connect them with."""
    least = nodes[at].copy()
    while True:
        before = least.copy()
        np.minimum.at(least, edges[:, 0], before[edges[:, 1]])
        np.minimum.at(least, edges[:, 1], least[edges[:, 0]])
        if (least == before).all():
            break
    root[at] = np.minimum(root[at], least)


def linked(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row (id, n_links, component) for each row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or id, link
    with nothing: no links, and they are their own component. Vectors of different lengths don't link. Rows that
    repeat are vectors of their own that link with each other. An empty table gives an empty result."""
    element = vectors.schema[vec_col].dataType.elementType
    vec = F.col(vec_col) if isinstance(element, (T.FloatType, T.DoubleType)) else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"))
    kind = rows.schema["vec"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, s0 = _Good(b), np.zeros(b.num_rows, np.int64)
            for _, v, members in good.groups():
                s = signs(v)[:, 0]
                for k, m in enumerate(members):
                    s0[m] = s[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s0, mask=~good.ok)], ["id", "s0"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = _Good(b)
            for at, v, members in good.groups():
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, members)]), pa.int32()), pa.array(good.ids[np.concatenate(members)]))
                yield pa.RecordBatch.from_arrays([pa.array(signs(v)[:, 0]), pa.array(good.labels[at]), good.lists.take(pa.array(at)), ids], ["s0", "label", "vec", "ids"])

    light = saved(rows.mapInArrow(keyed, "id long, s0 long"))
    n = light.count()
    parts_of = components(_candidates(_placed(rows, threshold), threshold, n))
    several = light.where("s0 is not null").groupBy("s0").agg(F.count(F.lit(1)).alias("n")).join(parts_of, F.col("s0") == F.col("node"), "left")
    wanted = saved(several.where("n > 1 or component is not null").select("s0", F.coalesce("component", "s0").alias("comp")))
    members = rows.mapInArrow(distinct, f"s0 long, label long, vec {kind}, ids array<long>").join(wanted, "s0")
    members = saved(members.select("comp", "label", "vec", "ids", F.monotonically_increasing_id().alias("node")))
    least = max(BLOCK, n // HUBS)
    size = F.least(F.greatest(F.col("n") / BLOCKS, F.lit(least)), F.lit(max(FULL, least)))
    blocks = members.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("comp", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    pairs = _block_pairs(members.join(F.broadcast(blocks), "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), F.xxhash64("node"))  # at most HUBS groups
    by = ["comp", "a", "b"]
    found = saved(pairs.select(*by, "side", "label", "node", "vec", "ids").repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda x: _compared(x, threshold), "node long, n long, root long, ids array<long>"))
    links = found.groupBy("node").agg(F.sum("n").alias("n_links"), F.first("ids", ignorenulls=True).alias("ids"))
    linked_nodes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = links.join(linked_nodes, "node", "left").select(F.explode("ids").alias("id"), "n_links", F.coalesce("component", "node").alias("c"))
    named = saved(named)
    smallest = named.groupBy("c").agg(F.min("id").alias("component"))
    alone = light.join(wanted, "s0", "left_anti").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return joined(named, smallest, "c", "id").select("id", "n_links", "component").union(alone)
