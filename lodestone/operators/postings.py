"""An inverted index as tables, and BM25 that reads only the postings of a query's tokens.

Postings are stored as lists (token, ids, lengths, tfs), one for each token of a slice of documents, dealt to parts by a
hash of the token and sorted by token in each, so that a query lists a folder for each of its tokens and reads the row
groups that hold them. The number of documents and their mean length stand beside them. One query over a table without
an index costs less by reading its texts (bm25_of). An index belongs to the files that it was made of: it is built when it is first asked for, and
again when a file changes."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .relations import checkpoint_dir

K1, B, PARTS = 1.5, 0.75, 64
SLICE = 2 << 20  # characters of the documents whose postings are listed together
SPACE = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def part_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PARTS)).cast("int")


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, length, token, tf) for each distinct token of a document; a null text has none.

    Tokens are counted in the tasks that make them; what travels is a number for each token of a document. Rows with one
    id and one length are one document."""
    rows = docs.select(F.col(id_col).alias("id"), X.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    each = rows.select("id", F.size("t").alias("length"), F.explode("t").alias("token"))
    return each.groupBy("id", "length", "token").agg(F.count(F.lit(1)).alias("tf"))


class _Numbers(dict):
    """A number for each token, in order of appearance."""

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


def _lists(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """The postings (token, ids, lengths, tfs) of some texts in lower case; their tokens are those of functions.text.tokens."""
    number, n, word = _Numbers(), len(texts), re.compile(X.WORDS)
    words = [word.findall(t) for t in texts]
    many = np.array([len(w) for w in words], np.int64)
    keys = [np.fromiter((number[x] for w in words for x in w), np.int64, int(many.sum())) * n + np.repeat(np.arange(n), many)]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in texts])
    kept = ~np.isin(points, SPACE)
    points, owner = points[kept].astype(np.int64), owner[kept]
    size = np.bincount(owner, minlength=n)
    for k in (2, 3):
        if len(points) < k:
            continue
        one = owner[: len(owner) - k + 1] == owner[k - 1 :]  # runs inside a text
        run = np.zeros(len(one), np.int64)
        for i in range(k):
            run = run << 21 | points[i : len(one) + i]
        runs, at = np.unique(run[one], return_inverse=True)
        text = np.stack([runs >> 21 * i & 0x1FFFFF for i in range(k - 1, -1, -1)], 1).astype("<u4").tobytes().decode("utf-32-le")
        tokens = np.fromiter((number[text[i : i + k]] for i in range(0, len(text), k)), np.int64, len(runs))
        keys.append(tokens[at] * n + owner[: len(one)][one])
    length = (many + np.maximum(size - 1, 0) + np.maximum(size - 2, 0)).astype(np.int32)
    found, tf = np.unique(np.concatenate(keys), return_counts=True)
    doc = found % n
    starts = np.searchsorted(found, np.arange(len(number) + 1) * n).astype(np.int32)
    lists = (ids.take(pa.array(doc)), pa.array(length[doc]), pa.array(tf.astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), *(pa.ListArray.from_arrays(pa.array(starts), x) for x in lists)], ["token", "ids", "lengths", "tfs"])


def listed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (token, ids, lengths, tfs): what counted has, as lists of the documents of a slice that hold a token.

    Only a list for each token of a slice is moved and sorted. Slices are of whole documents. Rows whose id comes again
    may be one document and go through counted."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts]) // SLICE
            cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), len(texts)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    yield _lists(b.column(0).slice(lo, hi - lo), texts[lo:hi])

    schema = f"token string, ids array<{kind}>, lengths array<int>, tfs array<bigint>"
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id")
    some = not again.isEmpty()
    once = rows.join(again, rows["id"].eqNullSafe(again["id"]), "left_anti") if some else rows
    out = once.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(of, schema)
    if some:
        rest = counted(rows.join(again, rows["id"].eqNullSafe(again["id"]), "left_semi"), "id", "text")
        out = out.unionByName(rest.select("token", F.array("id").alias("ids"), F.array("length").alias("lengths"), F.array("tf").alias("tfs")))
    return out


def state(docs: DataFrame) -> str:
    """What the rows of docs are read from: a hash of the paths, sizes and times of their files."""
    m = F.col("_metadata")
    files = docs.select(m["file_path"].alias("p"), m["file_size"].alias("s"), m["file_modification_time"].cast("string").alias("t")).distinct()
    found = files.agg(F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return f"{found['n']}-{found['h']}"


@dataclass
class Index:
    path: str
    postings: DataFrame
    n: int
    mean: float


def index(docs: DataFrame, id_col: str, text_col: str, root: str | None = None) -> Index:
    """The index of a table read from files, under root or the shared folder; built if it isn't there."""
    spark = docs.sparkSession
    named = f"{id_col}/{text_col}/{state(docs)}"
    path = f"{root or checkpoint_dir(spark)}/postings-{hashlib.sha256(named.encode()).hexdigest()[:24]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(path)):
        made = f"{path}-{uuid.uuid4().hex}"
        files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTS)  # of a part
        rows = listed(docs, id_col, text_col).withColumns({"part": part_of(F.col("token")), "_f": F.pmod(F.hash("token"), F.lit(files))})
        rows.repartition("part", "_f").drop("_f").sortWithinPartitions("part", "token").write.partitionBy("part").parquet(f"{made}/postings")
        lengths = docs.select(X.token_count(F.coalesce(F.col(text_col), F.lit(""))).alias("length"))
        lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).write.parquet(f"{made}/stats")
        if not fs.rename(at(made), at(path)) and not fs.exists(at(path)):  # another run may have been first
            raise RuntimeError(f"the index can't be moved to {path}")
    stats = spark.read.parquet(f"{path}/stats").first()
    kind = docs.schema[id_col].dataType.simpleString()
    held = spark.read.schema(f"token string, ids array<{kind}>, lengths array<int>, tfs array<bigint>, part int").parquet(f"{path}/postings")
    flat = held.select("token", "part", F.explode(F.arrays_zip("ids", "lengths", "tfs")).alias("p"))
    flat = flat.select(F.col("p.ids").alias("id"), F.col("p.lengths").alias("length"), "token", F.col("p.tfs").alias("tf"), "part")
    return Index(path, flat, stats["n"], stats["mean"] or 1.0)


def read_for(found: Index, tokens: list[str]) -> DataFrame:
    """The postings of some tokens; other parts aren't listed, other row groups not read."""
    parts = F.col("part").isin(*[part_of(F.lit(t)) for t in tokens])
    return found.postings.where(parts & F.col("token").isin(*tokens)).drop("part")


def _scores(rows: DataFrame, terms: Counter, n: int, mean: float, id_col: str) -> DataFrame:
    """(id, score) from the postings of the terms; the only thing that comes to the driver is the holders of each term."""
    holders = {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not holders:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    by_token = lambda of: F.create_map(*[F.lit(x) for t in holders for x in (t, float(of[t]))])[F.col("token")]
    df = by_token(holders)
    weight = by_token(terms) * F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * F.col("length") / F.lit(mean))
    return rows.groupBy(F.col("id").alias(id_col)).agg(F.sum(weight * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("score"))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, root: str | None = None) -> DataFrame:
    """(id, score) of the documents of a table read from files that share a token with the query, by stored postings."""
    terms = Counter(X.query_tokens(query))
    if not terms:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    found = index(docs, id_col, text_col, root)
    return _scores(read_for(found, sorted(terms)), terms, found.n, found.mean, id_col)


def bm25_of(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """The same for any DataFrame, whose texts are read once: their lengths, and the query's tokens in them.

    A document leaves a row for its length and one for each token of the query that it holds, which are stored."""
    terms = Counter(X.query_tokens(query))
    if not terms:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    checkpoint_dir(docs.sparkSession)
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    cut = low.select("id", F.regexp_replace("low", r"\s+", "").alias("c"), F.regexp_extract_all("low", F.lit(X.WORDS), F.lit(0)).alias("w"))
    held = F.filter("w", lambda x: x.isin(*sorted(terms)))
    cut = cut.select("id", "c", X.tokens_in(F.size("w"), F.char_length("c")).alias("length"), held.alias("w"))
    tf = lambda t: (X.occurrences(F.col("c"), t) if len(t) in (2, 3) else F.lit(0)) + F.size(F.filter("w", lambda x: x == t))
    each = F.array(F.struct(F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("tf")), *[F.struct(F.lit(t).alias("token"), tf(t).cast("long").alias("tf")) for t in sorted(terms)])
    rows = cut.select("id", "length", F.inline(F.filter(each, lambda x: x["token"].isNull() | (x["tf"] > 0))))
    rows = rows.repartition("id").groupBy("id", "length", "token").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("rows")).checkpoint()
    corpus = rows.where("token is null").agg(F.sum("rows").alias("n"), (F.sum(F.col("length") * F.col("rows")) / F.sum("rows")).alias("mean")).first()
    return _scores(rows.where("token is not null"), terms, corpus["n"] or 0, corpus["mean"] or 1.0, id_col)
