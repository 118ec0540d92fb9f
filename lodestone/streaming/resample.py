"""An addition of ours: the batch resample as a stream with a watermark for late samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resampled_stream(facts: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Totals of each series and window; a window is final when the watermark has passed its end."""
    return (
        facts.withWatermark("ts", late)
        .groupBy("entity", "metric", F.window("ts", width).alias("w"))
        .agg(F.count("value").alias("n"), F.sum("value").alias("sum_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
        .select("entity", "metric", F.col("w.start").alias("bucket"), "n", "sum_value", "min_value", "max_value")
    )


def new_tasks(tasks: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first task of each key; the same key again within the watermark is no new task."""
    return tasks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])
