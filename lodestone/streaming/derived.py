"""Results that are made once for each content: a stream over new files, and a store by hash and parser version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def refreshed(spark: SparkSession, files: str, store: str, version: str, parse: Callable[[DataFrame], DataFrame], content: str = "content", shape: str = "path string, content string") -> dict[str, int]:
    """Brings the store up to date with Parquet files (path, content) under a folder; how many rows were new, and how many parsed.

    The stream's log under the store knows which files have been read for this version: a second run reads none of them
    again. Of new rows those are parsed whose content (SHA-256) the store doesn't have for this version; parse gets (sha,
    content), a row for each, and returns (sha, result). Results are kept by version, names (path, sha) beside them, and
    a batch that runs again after a failure replaces its own files, so nothing is stored twice. Another version starts anew."""
    base = f"{store}/{version}"
    counts = {"rows": 0, "parsed": 0}

    def of(batch: DataFrame, number: int) -> None:
        named = batch.select("path", F.sha2(F.col(content).cast("binary"), 256).alias("sha"), content).persist()
        known = held(spark, store, version, number)
        new = named.groupBy("sha").agg(F.first(content).alias(content))
        new = new if known is None else new.join(known.select("sha"), "sha", "left_anti")
        parse(new).write.mode("overwrite").parquet(f"{base}/results/batch={number}")
        named.select("path", "sha").write.mode("overwrite").parquet(f"{base}/names/batch={number}")
        counts["rows"] += named.count()
        counts["parsed"] += spark.read.parquet(f"{base}/results/batch={number}").count()
        named.unpersist()

    stream = spark.readStream.schema(shape).parquet(files)
    run = stream.writeStream.foreachBatch(of).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return counts


def held(spark: SparkSession, store: str, version: str, before: int | None = None, what: str = "results") -> DataFrame | None:
    """What the store has for a version, of batches before one if that is given; None if there is nothing."""
    path = f"{store}/{version}/{what}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = spark.read.parquet(path)
    return rows.drop("batch") if before is None else rows.where(F.col("batch") < before).drop("batch")
