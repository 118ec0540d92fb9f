"""What several operators need: checkpoints, row groups inside a task, connected components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local session, as in tests, gets a temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: computed once, and safe when executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """How many parts of about each bytes; at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // each))


def released() -> None:
    """Gives memory that a worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """Tables of whole groups from batches sorted by keys, with the offsets where groups start, and the end.

    Only the last group of a batch is carried over. A group that grows beyond most rows, if given, comes in pieces
    instead, each with None for its offsets, so that memory holds a batch and most rows."""
    kept: list[pa.RecordBatch] = []
    carried, over, last = 0, False, None
    for b in batches:
        if not b.num_rows:
            continue
        values = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        new[0] = last is None or any(v[0] != x for v, x in zip(values, last, strict=True))
        last = [v[-1] for v in values]
        at = np.flatnonzero(new)
        if over:
            head = int(at[0]) if len(at) else b.num_rows
            if head:
                yield pa.Table.from_batches([b.slice(0, head)]), None
            if head == b.num_rows:
                continue
            over, b, at = False, b.slice(head), at - head
        if len(at) and (carried or len(at) > 1):
            end = int(at[-1])
            starts = np.concatenate([[0] * bool(carried), at + carried]).astype(np.int64)
            if starts[-1]:
                yield pa.Table.from_batches([*kept, b.slice(0, end)]), np.unique(starts)
            kept, carried = [b.slice(end)], b.num_rows - end
        else:
            kept.append(b)
            carried += b.num_rows
        if most is not None and carried > most:
            yield pa.Table.from_batches(kept), None
            kept, carried, over = [], 0, True
    if kept:
        yield pa.Table.from_batches(kept), np.array([0, carried])


HEAVY, HUBS, SMALL = 256, 100_000, 1_000_000


def joined(rows: DataFrame, table: DataFrame, key: str, spread: str, n: int | None = None, how: str = "inner") -> DataFrame:
    """rows joined with table, which holds each key once; the rows of a frequent key are dealt over several tasks.

    A key is frequent if it has more than HEAVY rows and more than a HUBS-th of all; its row of table is copied for each
    part, and its rows are dealt by column spread. There are at most HUBS such keys, so that their list is broadcast. Up
    to SMALL rows one task can do them all, and nothing is dealt. n is the number of rows, or more, if it is known."""
    n = rows.count() if n is None else n
    if n <= SMALL:
        return rows.join(table, key, how)
    heavy = max(HEAVY, n // HUBS)
    hubs = F.broadcast(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy).select(key, F.ceil(F.col("_n") / heavy).cast("int").alias("_parts")))
    dealt = rows.join(hubs, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copied = table.join(hubs, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


#: Edges that a task connects at once; left edges that one task connects, whatever the input was.
CHUNK, REST = 1 << 19, 1 << 18


def _rank(x: np.ndarray, level: int) -> np.ndarray:
    """An order of 64-bit numbers, another one for each level, without ties."""
    r = (x.view(np.uint64) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    r = (r ^ (r >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return r ^ (r >> np.uint64(29))


def _rooted(u: np.ndarray, v: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), and for each the node of least rank that it is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.argsort(_rank(nodes, level))
    place = np.empty(len(nodes), np.int64)
    place[order] = part = np.arange(len(nodes))
    a, b = place[at[: len(u)]], place[at[len(u) :]]
    while len(a):
        np.minimum.at(part, np.maximum(a, b), np.minimum(a, b))
        while (part[part] != part).any():
            part = part[part]
        a, b = part[a], part[b]
        a, b = a[a != b], b[a != b]
    return nodes[order], nodes[order[part]]


def _stars(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """(x, r): each node of a chunk of edges and its root in the chunk; a root is its own."""
    held, n = [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        yield from pa.table(dict(zip("xr", _rooted(t["u"].to_numpy(), t["v"].to_numpy(), level), strict=True))).to_batches(1 << 16)

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield from rows()
            held, n = [], 0
    if n:
        yield from rows()


def _met(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Of the roots r of a node x, edges (u, v, true) that join them to the least; (x, least, false) if x is no root."""
    for t, starts in sorted_groups(batches, ["x"]):
        x, r = t["x"].to_numpy(), t["r"].to_numpy()
        rank, group = _rank(r, level), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.lexsort((rank, group))
        x, r, group, starts = x[order], r[order], group[order], starts[:-1]
        least, alone = r[starts], ~np.logical_or.reduceat(x == r, starts)
        new = (r != least[group]) & np.append(True, (r[1:] != r[:-1]) | (group[1:] != group[:-1]))
        cols = [np.concatenate([r[new], x[starts][alone]]), np.concatenate([least[group][new], least[alone]]), np.arange(new.sum() + alone.sum()) < new.sum()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["u", "v", "open"])


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Rows (node, component): the smallest node reachable over edges (u, v), for each node on an edge.

    In each round tasks connect the edges they hold, which gives every node a root in each task, and the roots of one node
    meet. A node that is nowhere a root is settled: it goes where its least root goes. Edges between roots are left for the
    next round, which ranks nodes anew, so that a third of a chain is settled in each, however its ids are ordered. A node has
    a row for each task that holds it, so no step has the edges of a frequent node, or a component, in one task; at most REST
    edges that are left after a round are connected by one task. Settled nodes then follow their roots, round by round
    backwards, in joins that are dealt beyond SMALL rows (see joined). Null ends and loops are left out; an empty input gives no rows. Raises if edges are left after max_rounds."""
    now, settled = edges.where("u is not null and v is not null and u <> v").select("u", "v"), []
    for level in range(max_rounds):
        met = now.mapInArrow(lambda b, k=level: _stars(b, k), "x long, r long").repartition("x").sortWithinPartitions("x").mapInArrow(lambda b, k=level: _met(b, k), "u long, v long, open boolean")
        seen = Observation()
        met = saved(met.observe(seen, F.count_if("open").alias("open"), F.count_if(~F.col("open")).alias("settled")))
        settled.append((met.where("not open").select(F.col("u").alias("node"), F.col("v").alias("root")), seen.get["settled"]))
        now = met.where("open").select("u", "v")
        if not seen.get["open"]:
            break
        if seen.get["open"] <= REST:
            now = now.repartition(1)
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    found, n = settled.pop()
    while settled:
        rows, more = settled.pop()
        ends = found.select(F.col("node").alias("root"), F.col("root").alias("end"))
        found, n = saved(joined(rows, ends, "root", "node", more, "left").select("node", F.coalesce("end", "root").alias("root")).union(found)), n + more
    least = found.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("component"))
    return joined(found, least, "root", "node", n).select("node", "component").union(least.select(F.col("root").alias("node"), "component"))
