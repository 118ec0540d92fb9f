import os
import random

import duckdb
import pytest

from lodestone.llm import quality_model as M
from lodestone.llm import quality_rules as Q
from lodestone.llm.queries import OP9_SQL


def test_rules_against_sql(documents, corpus):
    import pandas as pd

    docs = documents.where("doc_id <> 5 and doc_id is not null").select("doc_id", "text", "source").toPandas()
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(docs))
    want = sorted(tuple(r) for r in db.sql(OP9_SQL).fetchall())
    spark = documents.sparkSession
    df = spark.createDataFrame(docs.astype(object).where(docs.notna(), None).values.tolist(), "doc_id long, text string, source string")
    got = Q.judged(df, keep=("doc_id",)).select("doc_id", "_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_kept")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_rules_on_edges(documents, corpus, no_documents):
    out = Q.judged(documents, keep=("doc_id", "g"))
    rows = {r["g"]: r for r in out.collect()}
    assert len(rows) == len(corpus) and rows[67]["_base_failed"] and rows[67]["_n_words"] == 0
    assert rows[69]["_n_repeat_words"] == 400
    kept = Q.accepted(documents)
    assert kept.columns == documents.columns and kept.count() == sum(r["_kept"] for r in rows.values())
    assert Q.judged(no_documents, keep=("doc_id",)).collect() == []


def test_hosts_decide(spark):
    clean = "the quick brown fox jumps over the lazy dog and runs far away from here"
    junk = " ".join(w + "###" for w in clean.split())
    rows = [("bad", junk)] * 50 + [("bad", clean)] * 50 + [("good", clean + f" {i}") for i in range(400)] + [("good", junk)]
    out = Q.judged(spark.createDataFrame(rows, "host string, text string"), host="host", keep=("host", "text")).collect()
    kept = {(r["host"], r["text"] == junk): r["_kept"] for r in out}
    assert kept == {("bad", True): False, ("bad", False): True, ("good", True): True, ("good", False): True}


def labelled(n=400):
    rng = random.Random(3)
    common = "the of and to a in is it that for was with as by".split()
    rare = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(2000)]
    prose = lambda k: " ".join(rng.choice(common if rng.random() < 0.4 else rare) for _ in range(k)).capitalize() + "."
    bad = [
        lambda: " ".join(rng.choice(rare) + rng.choice(["***", "###", "$$$"]) for _ in range(80)),
        lambda: " ".join(rng.choice(rare).upper() + "!!" for _ in range(80)),
        lambda: " ".join(rng.choice(rare) for _ in range(8) for _ in range(1)) + " " + " ".join([rng.choice(rare)] * 60),
    ]
    return [(i, prose(rng.randint(30, 120)) if i % 5 else rng.choice(bad)(), i % 5 != 0) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = labelled()
    train = spark.createDataFrame([r[:2] for r in rows[:300]], "doc_id long, text string")
    model, known = M.trained(train)
    scorer = M.Scorer(model)
    right = sum((scorer.probability(t.encode()) >= 0.5) == good for _, t, good in rows[300:])
    assert right >= 95 and known


def test_classifier_on_edges(spark, documents, corpus, no_documents):
    out = M.scored(documents).collect()
    assert len(out) == len(corpus) and all(0 <= r["score"] <= 1 for r in out)
    assert all(not r["kept"] for r in out if r["id"] in (67, 68))
    assert M.accepted(documents).columns == documents.columns
    assert M.scored(no_documents).collect() == [] and M.accepted(no_documents).collect() == []


@pytest.mark.parametrize("n", [2000, 20_001])
def test_rows_without_ids_get_both_verdicts(spark, n):
    good, bad = "the cat and the dog are in the house of a man that was old and it is as it was for him to be there", "### $$$ " * 30
    df = spark.range(n).selectExpr("cast(null as long) AS doc_id", f"CASE WHEN id % 2 = 0 THEN '{good}' ELSE rpad('{bad}', length('{good}'), '#') END AS text")
    verdicts = {(r["text"] == good) for r in M.accepted(df, sample=500).distinct().collect()}
    assert verdicts == {True} and M.accepted(df, sample=500).count() == (n + 1) // 2


def test_one_class_alone(spark):
    good = spark.range(50).selectExpr("id AS doc_id", "concat('the cat and the dog are in the house of a man that was old and it is as it was for ', id) AS text")
    assert M.accepted(good).count() == 50
    assert M.accepted(spark.range(5).selectExpr("id AS doc_id", "cast(null as string) AS text")).count() == 0


def test_votes_of_long_texts():
    long = b"the word of a man and " * 200_000
    assert len(M.votes(long)) == M.HEURISTICS and M.features(long, M.Known(M.word_features))[0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_against_labels(spark):
    d = "/root/testdata/sf0.01"
    out = M.scored(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("doc_id", "id"), "id").select("quality", "kept").collect()
    bad, good = [r["kept"] for r in out if r["quality"] == 0], [r["kept"] for r in out if r["quality"] == 1]
    assert len(bad) > 20 and len(good) > 20 and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.98 * len(good)


def test_each_row_has_its_own_verdict(spark):
    """Rows with equal ids and texts on a good and on a bad host, and rows that differ in what is null."""
    clean = "the quick brown fox jumps over the lazy dog and runs far away from here"
    junk = " ".join(w + "###" for w in clean.split())
    rows = [(i, junk, "bad") for i in range(60)] + [(i, clean, "good") for i in range(400)] + [(1, junk, "good"), (None, clean, None), (7, None, "good"), (None, junk, "bad")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, _k1 int, _host int")
    kept = Q.accepted(df).collect()
    assert (1, junk, "good") in {tuple(r)[:3] for r in kept} and not any(r["source"] == "bad" for r in kept)
    assert len(kept) == 402 and (None, clean, None) in {tuple(r)[:3] for r in kept}
