"""Writers: records and facts as partitioned Parquet, and a manifest of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


def write_facts(facts: DataFrame, path: str, by: tuple[str, ...] = ("metric",)) -> None:
    """Facts partitioned by metric, so that a plan's metric prunes files. Each metric is dealt to several tasks by time."""
    facts.repartition(*by, F.date_trunc("day", "ts")).write.partitionBy(*by).mode("overwrite").parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Records as Parquet, and beside them a row for each field: its name, type and whether it may be null."""
    records.write.mode("overwrite").parquet(f"{path}/records")
    fields = [(f.name, f.dataType.simpleString(), f.nullable) for f in records.schema.fields]
    records.sparkSession.createDataFrame(fields, "field string, type string, nullable boolean").write.mode("overwrite").json(f"{path}/fields")


def write_vectors(vectors: DataFrame, id_col: str, vec_col: str, space: str, path: str) -> None:
    """Vectors of length one, partitioned by their space, so that a search reads one space only. Zero vectors are left out."""
    size = V.norm(F.col(vec_col))
    vectors.where(size > 0).select(id_col, space, V.unit(F.transform(vec_col, lambda x: x.cast("double"))).alias(vec_col)).write.partitionBy(space).mode("overwrite").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of the files below path; contents are hashed in tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def verified(spark: SparkSession, path: str, listed: DataFrame, folder: Column | None = None) -> DataFrame:
    """(path, status, content) of the files below a path and of those that a manifest (path, sha256, size) lists.

    A file is read once; its content is hashed in the task that reads it, and comes out only if it is what the manifest
    says. Others are SIZE_MISMATCH, SHA256_MISMATCH, UNLISTED, or MISSING from the folder. The manifest names files by their
    path, or by what folder makes of it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path") if folder is None else folder.alias("path"), "content", F.col("length").alias("is_size"), F.sha2("content", 256).alias("is_sha"), F.lit(True).alias("there"))
    both = files.join(listed.select("path", "sha256", "size", F.lit(True).alias("named")), "path", "full")
    status = F.when(F.col("there").isNull(), "MISSING").when(F.col("named").isNull(), "UNLISTED").when(F.col("is_size") != F.col("size"), "SIZE_MISMATCH").when(F.col("is_sha") != F.lower("sha256"), "SHA256_MISMATCH").otherwise("OK")
    return both.select("path", status.alias("status"), "content").withColumn("content", F.when(F.col("status") == "OK", F.col("content")))
