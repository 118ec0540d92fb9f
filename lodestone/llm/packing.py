"""Best-fit packing of documents into sequences of several permitted lengths, chosen jointly.

Documents longer than the largest length are cut into pieces of that length and a rest. Pieces are dealt at random to
shards of about SHARD pieces, and each shard is packed by best fit, longest first: a piece goes where it leaves the least
room. If it fits nowhere, a bin is opened, and the permitted lengths compete for it: each is filled, on trial, with the
largest pieces still to place that fit, and the length whose bin, downsized to those contents, costs least for each
token is opened. Trials see one bin at a time, so the shard is also packed with every bin opened at one length, and the
packing of the least total cost stays. When all is placed, each bin shrinks to the smallest permitted length that holds
its contents. Shards are packed alone, which costs a bin or two each; memory and time of a task don't depend on the
corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

LENGTHS, SHARD, OVERHEAD = (256, 512, 768, 1024, 1536, 2048), 2000, 16.0


def bin_cost(length: int, overhead: float = OVERHEAD) -> float:
    """Of a sequence: its tokens, and a fixed part for each sequence."""
    return length + overhead


class Waiting:
    """The sizes still to place, as counts and as a number whose bit s is set if a piece of size s waits."""

    def __init__(self, sizes: list[int]):
        self.counts = [0] * (max(sizes, default=0) + 1)
        for s in sizes:
            self.counts[s] += 1
        self.bits = sum(1 << s for s, n in enumerate(self.counts) if n)

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.bits ^= 1 << size

    def filled(self, used: int, length: int) -> int:
        """Tokens in a bin of a length that holds used, once the largest waiting pieces that fit have joined it."""
        room, bits = length - used, self.bits
        while fitting := bits & ((2 << room) - 1):
            size = fitting.bit_length() - 1
            n = min(self.counts[size], room // size)
            room -= n * size
            bits &= (1 << size) - 1  # what fits now is smaller
        return length - room


def opened(size: int, waiting: Waiting, lengths: tuple[int, ...], overhead: float = OVERHEAD) -> int:
    """The length to open for a piece: that of the least cost for each token when filled from waiting and downsized."""

    def price(length: int) -> tuple[float, int]:
        fill = waiting.filled(size, length)
        return bin_cost(min(c for c in lengths if c >= fill), overhead) / fill, length

    return min((c for c in lengths if c >= size), key=price)


def packed_sizes(sizes: list[int], lengths: tuple[int, ...], overhead: float = OVERHEAD, one: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """For sizes in descending order: bin and offset in it for each, and the final length of each bin.

    If one is given, bins are opened at that length, or at the smallest that holds the piece where it is too small."""
    by_room: list[list[int]] = [[] for _ in range(max(lengths) + 1)]
    rooms = 0  # bit r is set if some bin has room r
    bins, offsets, used, waiting = [], [], [], Waiting(sizes)
    for size in sizes:
        waiting.take(size)
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(used), opened(size, waiting, lengths, overhead) if one is None else min(c for c in lengths if c >= max(size, one))
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, [min(c for c in lengths if c >= u) for u in used]


def best_packing(sizes: list[int], lengths: tuple[int, ...], overhead: float = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of the packings with competing lengths and with each length alone; on equal costs the first."""
    return min((packed_sizes(sizes, lengths, overhead, one) for one in (None, *reversed(lengths))), key=lambda p: sum(bin_cost(c, overhead) for c in p[2]))


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def packed(docs: DataFrame, id_col: str = "doc_id", size: Column | None = None, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD) -> DataFrame:
    """One row for each piece: id, piece, start and n_tokens in the document, bin, offset in it, bin_length.

    size is the number of tokens of a document; by default the words of column text. Documents without tokens (null
    and empty texts) have no piece; a negative or null size counts as none. Rows that repeat are packed as often as they
    come, and spread over shards like any others. Equal sizes are taken in the order of id and piece. An empty table gives an empty result."""
    lengths, top = tuple(sorted(lengths)), max(lengths)
    sizes = docs.select(F.col(id_col).cast("long").alias("id"), (word_count() if size is None else size).cast("long").alias("size")).where("size > 0")
    sizes = saved(sizes.withColumn("row", F.monotonically_increasing_id()))
    n_pieces = sizes.agg(F.sum(F.ceil(F.col("size") / top))).first()[0] or 0
    shards = max(1, -(-int(n_pieces) // SHARD))
    pieces = sizes.select("id", "size", "row", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / top) - 1).cast("int"))).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * F.lit(top)).cast("long").alias("start"), F.least(F.lit(top).cast("long"), F.col("size") - F.col("piece") * F.lit(top)).alias("n_tokens"), F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))

    def of(t: pa.Table) -> pa.Table:
        n, ids, piece = t["n_tokens"].to_numpy(), t["id"].fill_null(-(2**63)).to_numpy(), t["piece"].to_numpy()
        order = np.lexsort((piece, ids, -n))
        bins, offsets, final = best_packing(n[order].tolist(), lengths, overhead)
        t = t.take(pa.array(order))
        shard = int(t["shard"][0].as_py())
        names = ["id", "piece", "start", "n_tokens", "bin", "offset", "bin_length"]
        return pa.table([t["id"], t["piece"], t["start"], t["n_tokens"], pa.array(np.asarray(bins, np.int64) + (shard << 32)), pa.array(offsets, pa.int64()), pa.array([final[b] for b in bins], pa.int64())], names=names)

    return pieces.groupBy("shard").applyInArrow(of, "id long, piece int, start long, n_tokens long, bin long, offset long, bin_length long")
