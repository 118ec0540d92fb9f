"""Training data from documents: five stages, each written and read again as the next one's input.

Documents that the quality classifier or the quality rules reject go; one document of each group of near-duplicates
stays; repeated passages are taken out of the texts; what is left is packed into sequences.

The last stage gives the pieces of documents with their places in sequences; their words are those of the fourth stage's
texts, from start on.

Documents need the columns doc_id, text, source and n_chars; any others, whatever their names, are carried through the first
four stages. A null or empty text has no words: the classifier and the rules reject it. Rows that repeat are near copies,
of which one stays; rows with one id and different texts are different documents; a null source is a host of its own.
Texts are whole, however long. An empty table gives empty results at every stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import packing, quality_model, quality_rules, repeats, simhash, substring_dedup
from lodestone.llm.shared import checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.accepted(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cleaned(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", passages),
    ("best-fit packing", pack),
]

#: SQL can't express the trained scorer or the bins; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        repeats.release()
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
