"""The stored index against plain BM25, and what a query reads of it."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import postings as P


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["alpha", "beta", "Gamma_1", "温度", "的", "x", "delta-9"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(300, None), (301, "")]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "id long, text string").repartition(4).write.parquet(f"{at}/t")
    return at, rows


def plain(rows, query):
    docs = {i: Counter(X.query_tokens(t or "")) for i, t in rows}
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    out = Counter()
    for token, times in Counter(X.query_tokens(query)).items():
        df = sum(token in c for c in docs.values())
        for i, c in docs.items():
            if token in c:
                out[i] += times * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[token] * 2.5 / (c[token] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean))
    return {i: round(s, 9) for i, s in out.items()}


@pytest.mark.parametrize("query", ["alpha 温度", "gamma_1 gamma_1 x", "nothing-here?", "", "的"])
def test_scores(spark, corpus, query):
    at, rows = corpus
    docs = spark.read.parquet(f"{at}/t")
    want = plain(rows, query)
    for found in (P.bm25(docs, "id", "text", query, at), P.bm25_of(docs, "id", "text", query)):
        assert {r["id"]: round(r["score"], 9) for r in found.collect()} == pytest.approx(want)


def test_only_the_tokens_parts_are_read(spark, corpus):
    at, _ = corpus
    found = P.index(spark.read.parquet(f"{at}/t"), "id", "text", at)
    plan = P.read_for(found, ["alpha"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "In(token" in plan.replace("EqualTo(token", "In(token")


def test_index_follows_its_files(spark, corpus, tmp_path):
    at, rows = corpus
    docs = spark.read.parquet(f"{at}/t")
    assert P.index(docs, "id", "text", at).path == P.index(spark.read.parquet(f"{at}/t"), "id", "text", at).path
    spark.createDataFrame(rows[:10], "id long, text string").write.parquet(str(tmp_path / "t"))
    one = P.index(spark.read.parquet(str(tmp_path / "t")), "id", "text", at)
    spark.createDataFrame([(999, "alpha")], "id long, text string").write.mode("append").parquet(str(tmp_path / "t"))
    two = P.index(spark.read.parquet(str(tmp_path / "t")), "id", "text", at)
    assert (one.n, two.n) == (10, 11) and one.path != two.path
    assert two.postings.where(F.col("id") == 999).count() == len(set(X.query_tokens("alpha")))


def test_lists_hold_what_is_counted(spark, monkeypatch):
    rows = [(1, "aaa AaA a_b"), (2, None), (3, ""), (4, "温度 温度\u000b的x"), (5, "once"), (5, "once more"), (6, "the end 𝄞𝄞𝄞"), (7, "a"), (None, "no id"), (8, "İ ß")]
    monkeypatch.setattr(P, "SLICE", 12)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(2)
    flat = P.listed(docs, "id", "text").select("token", F.explode(F.arrays_zip("ids", "lengths", "tfs")).alias("p")).select("p.ids", "p.lengths", "token", "p.tfs")
    want = P.counted(docs, "id", "text")
    assert flat.exceptAll(want).isEmpty() and want.exceptAll(flat).isEmpty()
    sizes = docs.select((X.token_count(F.coalesce("text", F.lit(""))) == F.size(X.tokens(F.coalesce("text", F.lit(""))))).alias("same"))
    assert sizes.where("not same").isEmpty()


def test_texts_are_not_turned_into_tokens(spark, corpus):
    """A query without an index counts its own tokens; making those of every text took too long at 1 GB."""
    at, rows = corpus
    docs = spark.createDataFrame([(1, "aaaa aba"), (2, "ababa"), (2, "ababa"), (3, None), (4, "b")], "id long, text string")
    found = {r["id"]: r["score"] for r in P.bm25_of(docs, "id", "text", "aba aa").collect()}
    assert set(found) == {1, 2} and docs.select(X.occurrences(F.col("text"), "aba")).first()[0] == 1
    assert [r[0] for r in docs.select(X.occurrences(F.col("text"), "aa")).collect()] == [3, 0, 0, None, 0]
    assert docs.where("id = 2").select(X.occurrences(F.col("text"), "aba")).first()[0] == 2
