"""A mix of sources by target weights: a low-discrepancy schedule of slots, joined with shuffled blocks of equal tokens.

Weights share out the tokens of the mix; a source gives each of its documents at most so many times, and what it can't
take is shared again. The documents of a source are shuffled by a hash, laid end to end and cut into blocks of about
equal tokens. The mix is a row of slots: slot i belongs to the source into whose part of the cumulative weights the
i-th van der Corput point falls, so every stretch of slots holds the sources in nearly the weights asked for. The r-th
slot of a source takes its block r, and starts over at the end.

The points of a grid of 2**b are the reversed bits of its slots, so a source's slots come from its own part of the grid
and need no search. Ranks and offsets are sums over buckets of bounded size with the sums of the buckets before: no
source goes through one task. Joins with what grows with the documents are merges: blocks and slots compress so well that
their shuffled size would take them for small. Only totals come to the driver. The table of sources, a row each, is
numbered in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import word_count
from .shared import saved


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)  # of sources in the order of their names, repeating
    most: int = 3  # times that a source is gone through
    block: int = 1024  # tokens
    rows: int = 2000  # of documents in a bucket, about
    chunk: int = 1 << 16  # slots that one row makes


def reversed_bits(x: Column, b: int) -> Column:
    """x, below 2**b, with its b bits in reverse order."""
    for by, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        low = F.lit(mask)
        x = F.shiftrightunsigned(x, by).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(low), by))
    return F.shiftrightunsigned(F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32)), 64 - b)


def running(rows: DataFrame, key: str, bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with a column: the sum of value over the rows of a key before this one, in the order of bucket, then order.

    Buckets hold bounded numbers of rows. Their sums are added up in two levels, so that a window sees the rows of a
    bucket, some thousand buckets, or the thousands of a key."""
    before = lambda by, at: F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy(key, bucket).agg(F.sum(value).alias("_s")).withColumn("_over", F.floor(F.col(bucket) / 1000))
    over = parts.groupBy(key, "_over").agg(F.sum("_s").alias("_s")).select(key, "_over", before([key], "_over").alias("_base"))
    starts = parts.withColumn("_in", before([key, "_over"], bucket)).join(over, [key, "_over"]).select(key, bucket, (F.col("_base") + F.col("_in")).alias("_start"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts.hint("merge"), [key, bucket]).withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_start")


def shares(sizes: DataFrame, mix: Mix) -> DataFrame:
    """A row for each source (key, source): source_size, target, and its blocks and slots.

    With a level of tokens a unit of weight, a source takes level x weight or most times its size. Over sources in the
    order of size to weight, the level that the rest would have is highest at the right place."""
    found = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(mix.weights)
    found = saved(found.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in mix.weights]), (turn + 1).cast("int"))))
    total, weights = found.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    full = Window.orderBy(F.col("source_size") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    rest = lambda whole, part: (F.lit(whole) - F.coalesce(F.sum(part).over(full), F.lit(0))).cast("double")
    level = found.select((rest(total, mix.most * F.col("source_size")) / rest(weights, F.col("weight"))).alias("level")).agg(F.max("level")).first()[0] or 0.0
    found = found.withColumn("target", F.least((mix.most * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight")))
    found = found.where("source_size > 0").withColumn("tokens", F.floor(F.col("target") + 0.5).cast("long"))
    found = found.withColumn("length", F.ceil(F.col("source_size") / F.ceil(F.col("source_size") / mix.block))).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")))
    found = found.withColumn("slots", F.expr("tokens div source_size * blocks + cast(ceil(tokens % source_size / length) as long)"))
    first = F.coalesce(F.sum("slots").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return saved(found.withColumn("first", first).select("key", "source", "source_size", "target", "tokens", "length", "blocks", "slots", "first"))


def scheduled(plan: DataFrame, mix: Mix) -> DataFrame:
    """Rows (key, slot, block, epoch, begin, end): which part of which block of a source each slot takes."""
    n = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(1, int(n).bit_length())
    chunks = plan.where("slots > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(mix.chunk).cast("long"))))
    points = chunks.repartition("key", "at").select("key", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("at") + mix.chunk, F.col("slots")) - 1)).alias("point"))
    slots = points.select("key", reversed_bits(F.col("point"), bits).alias("slot")).withColumn("range", F.expr(f"slot div {mix.rows}"))
    ranked = running(slots, "key", "range", ["slot"], F.lit(1), "rank").join(plan, "key")
    epoch, block = F.expr("rank div blocks"), F.col("rank") % F.col("blocks")
    ranked = ranked.select("key", "slot", block.alias("block"), epoch.alias("epoch"), "length", "source_size", "tokens")
    end = F.least((F.col("block") + 1) * F.col("length"), F.col("source_size"), F.col("tokens") - F.col("epoch") * F.col("source_size"))
    return ranked.select("key", "slot", "block", "epoch", (F.col("block") * F.col("length")).alias("begin"), end.alias("end"))


@dataclass
class Mixed:
    rows: DataFrame  # id, size, source, key, and from: where a document begins in its shuffled source (null if empty)
    plan: DataFrame  # see shares()
    slots: DataFrame  # see scheduled()
    parts: DataFrame  # slot, epoch, block, key, from, start, n_tokens: what a slot takes of a document


def mixed(docs: DataFrame, id_col: str = "doc_id", source: str | Column = "source", size: Column | None = None, mix: Mix | None = None) -> Mixed:
    """The mix of all rows of docs.

    size is the number of tokens of a document, by default the words of column text; null and negative sizes count as
    none, and such documents stay in rows but in no slot. A null source is one of its own, the last; a null id is an id
    like others. Rows that repeat are taken each; with equal hash, id and size they change places without any effect.
    The cases of a document longer than a block (it spans several) and a source shorter than one (it is one block) are
    ordinary ones. Other columns are not looked at. Empty tables, and tables without tokens, give an empty mix."""
    mix = mix or Mix()
    source = F.col(source) if isinstance(source, str) else source
    tokens = F.greatest(F.coalesce((word_count() if size is None else size).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    sizes = docs.select(F.col(id_col).cast("long").alias("id"), source.cast("string").alias("source"), tokens.alias("size"))
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    sizes = saved(sizes.withColumn("key", key))
    n = sizes.count()
    plan = shares(sizes, mix)
    # the order of a source: by md5 of id and size
    shuffle = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")).cast("binary"))
    full = sizes.where("size > 0").withColumn("hash", shuffle).withColumn("bucket", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * F.lit(n // mix.rows + 1) / F.lit(2**32)))
    laid = saved(running(full, "key", "bucket", ["hash", "id", "size"], F.col("size"), "from").select("id", "size", "source", "key", "from"))
    slots = scheduled(plan, mix)
    cut = laid.join(plan.select("key", "length"), "key").select("key", "from", (F.col("from") + F.col("size")).alias("to"), F.explode(F.sequence(F.expr("`from` div length"), F.expr("(`from` + size - 1) div length"))).alias("block"))
    low, high = F.greatest("from", "begin"), F.least("to", "end")
    parts = cut.join(slots.hint("merge"), ["key", "block"]).where(low < high).select("slot", "epoch", "block", "key", "from", (low - F.col("from")).alias("start"), (high - low).alias("n_tokens"))
    return Mixed(laid.unionByName(sizes.where("size <= 0").withColumn("from", F.lit(None).cast("long"))), plan, slots, parts)


def taken(docs: DataFrame, id_col: str = "doc_id", source: str | Column = "source", size: Column | None = None, mix: Mix | None = None) -> DataFrame:
    """Rows (id, size, source_size, target, taken) for each row of docs: the tokens that the mix takes of it, repeats counted.

    Cases as in mixed(); the source of a document without tokens may be one without any, whose size and target are 0."""
    m = mixed(docs, id_col, source, size, mix)
    sums = m.parts.groupBy("key", "from").agg(F.sum("n_tokens").alias("taken"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    rows = m.rows.join(sums.hint("merge"), ["key", "from"], "left").join(m.plan.select("key", "source_size", "target"), "key", "left")
    return rows.select("id", "size", zero("source_size", "long"), zero("target", "double"), zero("taken", "long"))
