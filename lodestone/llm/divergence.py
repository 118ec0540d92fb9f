"""How the sources of a language differ in their terms: upper-bound search for the terms, postings for pairs of sources.

A term's share in a group of documents is a whole number p of billionths, smoothed by one; f(p, q) = (p - q)^2 / q,
rounded down, says how far p lies from q. For each group the terms with most f against the language are wanted. Terms of
a group are put into buckets of about equal counts, and for each bucket the greatest p and the least q of the language
bound f of all terms in it. Buckets are taken best bound first, a wave of them at a time, until a group has as many values
as are wanted and every bucket not yet seen has a bound strictly below the last of these: equal values, which the term
decides, are all seen. What is held for that is a row for each bucket, of which a group has some eight a doubling of counts.

Two sources of a language differ in all kept terms, of which most occur in neither. With p0 for a count of zero, the sum of
f(p, q) is that of f(p0, q0) over all terms, changed by the postings of the one, of the other, and of both; only the last
meet, and only in their term."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import released, saved

UNIT, LEAST_DOCS, TERMS, PARTS = 1_000_000_000, 3, 200, 32
FLUSH, STRETCH, FEW_GROUPS = 500_000, 1 << 20, 20_000
#: Bytes of terms stay, A-Z as a-z; all others part terms.
TABLE = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a stretch at a time."""
    lo = 0
    while lo < len(text):
        hi = lo + STRETCH
        part = text[lo:hi].translate(TABLE)
        while hi < len(text) and not part.endswith(b" "):  # a term goes on
            more = text[hi : hi + STRETCH].translate(TABLE)
            cut = more.find(b" ")
            more = more if cut < 0 else more[: cut + 1]
            part, hi = part + more, hi + len(more)
        yield part.split()
        lo = hi


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, term, count, docs): occurrences, and documents that hold the term; several for a term.

    Tasks add up what they have read and pass it on whenever that holds FLUSH terms, so that memory is bounded."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[tuple, Counter] = defaultdict(Counter)
        holders: defaultdict[tuple, Counter] = defaultdict(Counter)

        def flushed() -> Iterator[pa.RecordBatch]:
            for group, found in counts.items():
                n, held = len(found), holders[group]
                cols = [pa.array([group[i]] * n, pa.string()) for i in (0, 1)] + [pa.array(list(found), pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found.values(), pa.int64()), pa.array([held[t] for t in found], pa.int64())], ["lang", "source", "term", "count", "docs"])
            counts.clear()
            holders.clear()
            released()

        waiting = 0
        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in (0, 1)), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                group = lang, source
                found, own = counts[group], set()
                before = len(found)
                for terms in terms_of(text):
                    found.update(terms)
                    own.update(terms)
                holders[group].update(own)
                waiting += len(found) - before
                if waiting > FLUSH:
                    yield from flushed()
                    waiting = 0
        yield from flushed()

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    return rows.mapInArrow(of, "lang string, source string, term string, count long, docs long")


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(UNIT x (count + 1) / (n + v)); exact for any counts: what a long can't hold is done in decimals."""
    exact = f"(CAST({UNIT} AS DECIMAL(38,0)) * ({count} + 1L)) div ({n} + {v})"
    return F.expr(f"1L + CASE WHEN {count} < {(2**63 - 1) // UNIT - 1}L THEN ({UNIT}L * ({count} + 1L)) div ({n} + {v}) ELSE {exact} END")


def apart(p: str, q: str) -> Column:
    """f(p, q)."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def level(count: str) -> Column:
    """The bucket of a count: eight for each doubling, so that small counts have one each."""
    return F.floor(F.log2(F.col(count)) * 8).cast("int")


def best_terms(kept: DataFrame, groups: DataFrame, most: int = TERMS, few: bool = False) -> DataFrame:
    """Rows (lang, source, item, value, rank) of the terms with most f of each group, from the rows of kept_terms().

    Best-first over buckets; see above. A wave reads the postings of its buckets, named in the row of their group, and
    takes four times as many terms as the one before. Values are ranked in parts of a group first, so that no task
    gets more than PARTS times most of a group."""
    group = ["lang", "source"]
    rows = postings(kept, groups).where("p > q").withColumn("bucket", level("count"))
    buckets = rows.groupBy(*group, "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count(F.lit(1)).alias("terms"))
    ahead = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = saved(buckets.withColumn("bound", apart("p", "q")).withColumn("before", F.coalesce(F.sum("terms").over(ahead), F.lit(0))).select(*group, "bucket", "bound", "before"))
    order = (F.desc("value"), F.col("item"))
    best, seen, want = None, -1, most
    while True:
        wave = buckets.where((F.col("before") < want) & (F.col("before") > seen))
        if best is not None:  # what the values so far can't rule out
            wave = _open(wave, best, most)
        chosen = wave.groupBy(*group).agg(F.collect_list("bucket").alias("chosen"))
        named = groups.join(chosen, group)
        values = postings(kept, F.broadcast(named) if few else named).where("p > q").withColumn("bucket", level("count")).where(F.array_contains("chosen", F.col("bucket")))
        values = values.select(*group, F.col("term").alias("item"), apart("p", "q").alias("value"), F.pmod(F.xxhash64("term"), F.lit(PARTS)).alias("part"))
        values = values.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "part").orderBy(*order))).where(F.col("rank") <= most).drop("part", "rank")
        values = values if best is None else values.unionByName(best.drop("rank"))
        best = saved(values.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most))
        seen, want = want - 1, 4 * want
        if _open(buckets.where(F.col("before") > seen), best, most).isEmpty():
            return best


def _open(buckets: DataFrame, best: DataFrame, most: int) -> DataFrame:
    """The buckets whose bound isn't strictly below the last of the values that their group has, if it has as many as are wanted."""
    kth = best.where(F.col("rank") == most).select("lang", "source", F.col("value").alias("kth"))
    return buckets.join(kth, ["lang", "source"], "left").where("kth is null or bound >= kth").drop("kth")


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value): f summed over all kept terms, for each two sources of a language.

    groups has v, the number of terms of the language, and p0, the share of a term that doesn't occur. Two postings of a
    term meet in its row, so only sums by pairs of sources are shuffled."""
    a, b = groups.select("lang", "source", "v", "p0"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = a.join(b, "lang").where("source <> item")
    held = postings(kept, groups)
    counts = held.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    alone = counts.join(b, "lang").where("source <> item")
    mine = alone.select("lang", "source", "item", (F.col("n") * (apart("p", "q0") - apart("p0", "q0"))).alias("d"))
    theirs = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * (apart("q0", "p") - apart("q0", "p0"))).alias("d"))
    later = F.slice("held", F.col("i") + 2, F.size("held"))  # each two postings of a term once
    meet = held.select("lang", "source", "p", "p0", F.explode(later).alias("o")).select("lang", "source", "p", "p0", F.col("o.source").alias("item"), F.col("o.count").alias("other"))
    meet = meet.join(groups.select("lang", F.col("source").alias("item"), "n", "v", F.col("p0").alias("q0")), ["lang", "item"]).withColumn("q", share("other", "n", "v"))
    change = lambda p, q, p0, q0: F.sum(apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0))
    meet = meet.groupBy("lang", "source", "item").agg(change("p", "q", "p0", "q0").alias("d"), change("q", "p", "q0", "p0").alias("back"))
    ways = F.explode(F.array(F.struct("source", "item", "d"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("d"))))
    meet = meet.select("lang", ways.alias("w")).select("lang", "w.*")
    changes = mine.union(theirs).union(meet).groupBy("lang", "source", "item").agg(F.sum("d").alias("d"))
    value = F.col("v") * apart("p0", "q0") + F.coalesce(F.col("d"), F.lit(0))
    return both.join(changes, ["lang", "source", "item"], "left").select("lang", "source", "item", F.when(F.col("v") > 0, value).otherwise(F.lit(0)).cast("long").alias("value"))


def kept_terms(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Rows (lang, term, all, held) of the terms that languages keep: occurrences, and those of each source.

    The counts are dealt once, by language and term; a row holds a number for each source of the language at most."""
    by_source = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("held"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def postings(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, term, count, p, q, p0) for each source of a term, with the term's held, the source's place i in
    it, and the group's columns. Groups are broadcast if they are few."""
    rows = kept.select("lang", "term", "all", "held", F.posexplode("held").alias("i", "_h")).select("lang", F.col("_h.source").alias("source"), "term", F.col("_h.count").alias("count"), "all", "held", "i")
    return rows.join(groups, ["lang", "source"]).withColumns({"p": share("count", "n", "v"), "q": share("all", "lang_n", "v")})


def audited(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most: int = TERMS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of each group of documents of a language and a source.

    Part 'pair': the other sources of the language, by how far the group's terms lie from theirs. Part 'term': the terms
    that are more frequent in the group than in the language, by how far, up to rank most. A language keeps the terms in
    at least least_docs of its documents, rows that repeat counted each. Nulls in text, language and source count as
    empty; a group without terms has its pairs, a language of one source no pair, one without kept terms pairs of value 0.
    Texts are whole, however long, and are read a stretch at a time. Equal values are ranked by item. Other columns are not
    looked at. An empty table gives an empty result."""
    kept = saved(kept_terms(counted(docs, text_col, lang_col, source_col), least_docs))
    langs = kept.groupBy("lang").agg(F.sum("all").alias("lang_n"), F.count(F.lit(1)).alias("v"))
    sums = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.count").alias("n"))
    named = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")).distinct()
    groups = named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), "lang_n")
    groups = saved(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "n", "v")).otherwise(F.lit(1))))
    few = groups.count() <= FEW_GROUPS  # then a row for each, with its buckets, some 1000 bytes, goes to all tasks
    groups = F.broadcast(groups) if few else groups
    ranked = pairs(kept, groups).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(ranked, "pair").union(out(best_terms(kept, groups, most, few), "term"))
