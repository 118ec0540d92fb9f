"""Queries that have to read all they are given: long streams, long texts, large groups of copies."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestone import catalog


def test_stream_is_read_to_its_end(spark, tmp_path, monkeypatch):
    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda run, timeout=None: False if timeout else wait(run))
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=i), i % 3, "click", float(i)) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    for name, part in (("some", events), ("none", events.limit(0))):
        part.repartition(3).write.parquet(str(tmp_path / name / "events.parquet"))
    found = catalog.queries()["stream_resample"](spark, str(tmp_path / "some")).collect()
    assert len(found) == 15 and sum(r["n"] for r in found) == 300
    assert catalog.queries()["stream_resample"](spark, str(tmp_path / "none")).collect() == []


def test_mmr_reads_whole_texts_of_all_languages(spark, tmp_path):
    header = "the and of " + " ".join(f"head{i}" for i in range(60))
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(200))
    rows = [(k, f"{header} {body(k)}", "en" if k % 2 else "fr", "web") for k in range(4)]
    rows.append((4, f"opening words {header} {body(3)}", "en", "web"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["id"] for r in catalog.queries()["greedy_mmr"](spark, str(tmp_path)).collect()}
    assert {0, 1, 2} < found and len(found & {3, 4}) == 1


def test_no_copy_of_a_large_group_is_lost(spark, tmp_path):
    n = 300_003
    spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("b"), "id")).otherwise("a").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.queries()["evidence_identity_dedup"](spark, str(tmp_path))
    row = found.agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("kept"), F.max("n").alias("n"), F.max(F.when(F.col("n") > 1, F.col("doc_id"))).alias("last"), F.max(F.when(F.col("n") > 1, F.col("kept_id"))).alias("first")).first()
    assert tuple(row) == (n, n // 3 + 1, 2 * n // 3, n - 1, 1)
