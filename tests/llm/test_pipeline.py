"""The pipeline's stages, each against a plain version on the same input."""

import os

import corpus_pipeline as C
import duckdb
import pandas as pd
import pytest
from test_near_copies import brute as near_brute
from test_repeats import brute_words

from lodestone.llm import packing, quality_model
from lodestone.llm.queries import OP9_SQL

SF = "/root/testdata/sf0.001"


def by_classifier(rows, docs):
    judge = quality_model.Judge(*quality_model.trained(docs))
    return [r for r in rows if judge.score((r["text"] or "").encode()) >= 0.5]


def by_rules(rows, docs):
    db = duckdb.connect()
    db.register("documents", pd.DataFrame([r.asDict() for r in rows]))
    kept = {i for i, ok in db.sql(f"SELECT doc_id, kept FROM ({OP9_SQL})").fetchall() if ok}
    return [r for r in rows if r["doc_id"] in kept]


def by_copies(rows, docs):
    least = {c for _, c in near_brute([(r["doc_id"], r["text"]) for r in rows])}
    return [r for r in rows if r["doc_id"] in least]


def by_passages(rows, docs):
    first, out = {}, []
    for r in rows:
        w = (r["text"] or "").split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    gone = {i: n for i, _, n, _ in brute_words([(r["doc_id"], r["text"]) for r in rows])}
    for r in rows:
        w = (r["text"] or "").split()
        covered = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r["doc_id"] for j in range(k, k + 13)}
        assert len(covered) == gone[r["doc_id"]]
        text = " ".join(x for j, x in enumerate(w) if j not in covered) if covered else r["text"]
        out.append({**r.asDict(), "text": text, "n_chars": len(text)})
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    for (_, stage), plain in zip(C.STAGES, (by_classifier, by_rules, by_copies, by_passages), strict=False):
        rows = docs.collect()
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        want = sorted(tuple(r[c] for c in docs.columns) for r in plain(rows, docs))
        assert sorted(tuple(r) for r in out.collect()) == want
        counts.append(len(want))
        docs = out
    assert counts[0] < 200 and counts == sorted(counts, reverse=True) and counts[2] == counts[3] > 50
    pieces = C.STAGES[-1][1](spark, docs, SF).collect()
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    ends, shards = {}, {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == ends.get(r["doc_id"], 0)
        ends[r["doc_id"]] = r["start"] + r["n_tokens"]
        shards.setdefault(r["bin"] >> 32, []).append(r)
    assert ends == {i: n for i, n in words.items() if n}
    for shard in shards.values():
        sizes = sorted((r["n_tokens"] for r in shard), reverse=True)
        lengths = {r["bin"]: r["bin_length"] for r in shard}
        assert sorted(lengths.values()) == sorted(packing.best_packing(sizes, packing.LENGTHS)[2])


def test_hostile_rows(spark, documents):
    docs = documents.select("doc_id", "text", "lang", "source").selectExpr("*", "length(text) AS n_chars")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
