"""Time-series operators over facts in long form: entity, metric, ts, value (and unit, selected, row where they matter).

All work on many series at once: windows and groups are keyed by entity and metric, and no series is collected whole."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V

KEY = ["entity", "metric"]


def in_range(ts: Column, start: str, end: str, closed: bool = False) -> Column:
    start, end = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return (ts >= start) & (ts <= end if closed else ts < end)


def merged_samples(facts: DataFrame, unit: str | None = None) -> DataFrame:
    """One row for each (entity, metric, ts): the first value by row, copies, and whether another value or unit conflicts."""
    first = F.min_by("value", "row")
    apart = F.abs(F.col("value") - F.col("_first")) > F.greatest(F.lit(1e-9) * F.greatest(F.abs("value"), F.abs("_first")), F.lit(1e-12))
    w = Window.partitionBy(*KEY, "ts")
    rows = facts.withColumn("_first", F.min_by("value", "row").over(w))
    units = F.count_distinct(F.coalesce(F.col(unit), F.lit(""))) > 1 if unit else F.lit(False)
    return rows.groupBy(*KEY, "ts").agg(first.alias("value"), F.count(F.lit(1)).alias("copies"), (F.bool_or(apart) | units).alias("conflict"))


def totals(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """count, sum, min, max and average, and when the extremes first occurred."""
    t = F.unix_micros("ts")
    return facts.groupBy(*(keys or [])).agg(
        F.count("value").alias("n"),
        F.sum(F.col("value").cast("decimal(38,12)")).cast("double").alias("sum_value"),
        F.min("value").alias("min_value"),
        F.min_by("ts", F.struct(F.col("value"), t)).alias("min_at"),
        F.max("value").alias("max_value"),
        F.max_by("ts", F.struct(F.col("value"), -t)).alias("max_at"),
        F.avg(F.col("value").cast("decimal(38,12)")).cast("double").alias("average_value"),
    )


def running_total(facts: DataFrame, key: str) -> DataFrame:
    """(key, total) by adding days up to days: sums of each day first, then the last of their running sum."""
    days = facts.groupBy(key, F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("s"))
    run = days.withColumn("total", F.sum("s").over(Window.partitionBy(key).orderBy("day")))
    return run.groupBy(key).agg(F.max_by("total", "day").alias("total"))


def resampled(facts: DataFrame, unit: str) -> DataFrame:
    """Totals, first and last of each hour, day or other unit that has samples."""
    order = F.struct("ts", "row")
    return facts.groupBy(*KEY, F.date_trunc(unit, "ts").alias("bucket")).agg(
        F.count("value").alias("n"), F.sum(F.col("value").cast("decimal(38,12)")).cast("double").alias("sum_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value")
    )


def compared_periods(facts: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Mean of the second period minus mean of the first, for each series."""
    mean = lambda p: F.avg(F.when(in_range(F.col("ts"), *p), F.col("value").cast("decimal(38,12)"))).cast("double")
    return facts.groupBy(*KEY).agg(mean(first).alias("first_mean"), mean(second).alias("second_mean")).withColumn("change", F.col("second_mean") - F.col("first_mean"))


def trends(facts: DataFrame) -> DataFrame:
    """End minus start, slope per second (0 for one sample), and whether no value falls."""
    w = Window.partitionBy(*KEY).orderBy("ts", "row")
    x = (F.unix_micros("ts") - F.min(F.unix_micros("ts")).over(Window.partitionBy(*KEY))) / 1e6
    rows = facts.withColumn("_x", x).withColumn("_up", F.coalesce(F.col("value") >= F.lag("value").over(w), F.lit(True)))
    order = F.struct("ts", "row")
    return rows.groupBy(*KEY).agg((F.max_by("value", order) - F.min_by("value", order)).alias("start_end"), F.coalesce(F.regr_slope("value", "_x"), F.lit(0.0)).alias("slope"), F.bool_and("_up").alias("monotonic"))


def intervals(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Each pair of consecutive instants of a series that overlaps the window, with why it is left out, if it is.

    facts has value (null: no number) and selected. The usual spacing is the first quartile over the whole series; a gap
    is longer than three times that. A filtered end comes before a null one, and that before a gap."""
    w = Window.partitionBy(*KEY).orderBy("ts")
    us = F.unix_micros("ts")
    rows = facts.select(*KEY, "ts", us.alias("t"), "value", "selected", F.lead(us).over(w).alias("t2"), F.lead("value").over(w).alias("value2"), F.lead("selected").over(w).alias("selected2"))
    rows = rows.withColumn("q25", F.percentile(F.col("t2") - F.col("t"), 0.25).over(Window.partitionBy(*KEY))).drop("ts")
    low, high = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (start, end))
    rows = rows.where("t2 is not null").withColumns({"b": F.greatest("t", low), "f": F.least("t2", high)}).where("f > b")
    why = (
        F.when(~F.col("selected") | ~F.col("selected2"), "FILTERED_ENDPOINT")
        .when(F.col("value").isNull() | F.col("value2").isNull(), "NULL_OR_NON_NUMERIC_ENDPOINT")
        .when((F.col("q25") > 0) & (F.col("t2") - F.col("t") > 3 * F.col("q25")), "GAP_GREATER_THAN_THREE_SOURCE_Q25_INTERVALS")
    )
    return rows.withColumn("why", why)


def _operand(threshold: float | Decimal) -> float:
    """The largest double that is not above a threshold: none lies between the two, so that > stays exact."""
    if not isinstance(threshold, Decimal):
        return threshold
    near = float(threshold)
    return near if Decimal(near) <= threshold else math.nextafter(near, -math.inf)


def interval_statistics(facts: DataFrame, start: str, end: str, threshold: float | Decimal | None = None) -> DataFrame:
    """For each series: weighted mean (linear between samples, cut at the window, nothing beyond), seconds covered, and
    seconds above the threshold (a value holds until the next)."""
    x = intervals(facts, start, end)
    used = F.col("why").isNull()
    seconds = (F.col("f") - F.col("b")) / 1e6
    at = lambda t: F.col("value") + (F.col("value2") - F.col("value")) * (F.col(t) - F.col("t")) / (F.col("t2") - F.col("t"))
    area = F.sum(F.when(used, (at("b") + at("f")) * seconds / 2))
    covered = F.sum(F.when(used, seconds))
    above = F.sum(F.when(used, F.when(F.col("value") > (0.0 if threshold is None else _operand(threshold)), seconds).otherwise(0.0)))
    return x.groupBy(*KEY).agg((area / covered).alias("weighted_average"), covered.alias("covered_seconds"), above.alias("seconds_above"), F.count_if(used).alias("n_used"), F.count_if(~used).alias("n_excluded")).withColumn(
        "status", F.when(F.col("covered_seconds").isNull(), "NO_SUPPORTED_INTERVALS").otherwise("OK")
    )


def legacy_statistics(facts: DataFrame, start: str, end: str, threshold: float) -> DataFrame:
    """The older rule for each series: mean by trapezoids between the window's samples, and seconds for which a value over the
    threshold holds until the next sample. Window edges don't count; a step is left out as a gap if it is over three times the
    first quartile of the window's positive steps. A single sample is its own mean, and no time is above.

    flags says what that leaves open: TIME_WEIGHTING_UNDETERMINED, GAPS_EXCLUDED, or nothing."""
    w = Window.partitionBy(*KEY).orderBy("ts")
    us = F.unix_micros("ts")
    x = facts.where(in_range(F.col("ts"), start, end)).select(*KEY, "value", F.lead("value").over(w).alias("next"), (F.lead(us).over(w) - us).alias("step"))
    x = x.withColumn("step", F.when(F.col("step") > 0, F.col("step"))).withColumn("q25", F.percentile("step", 0.25).over(Window.partitionBy(*KEY)))
    gap = F.col("step") > 3 * F.col("q25")
    used = F.when(F.col("step").isNotNull() & ~gap, F.col("step") / 1e6)
    found = x.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.first("value").alias("only"), F.count_if(F.coalesce(gap, F.lit(False))).alias("gaps"),
        (F.sum((F.col("value") + F.col("next")) * used / 2) / F.sum(used)).alias("mean"), F.coalesce(F.sum(F.when(F.col("value") > threshold, used)), F.lit(0.0)).alias("seconds_above"),
    )
    single = F.col("n") == 1
    flags = F.when(single, "TIME_WEIGHTING_UNDETERMINED").when(F.col("gaps") > 0, "GAPS_EXCLUDED").otherwise("")
    return found.select(*KEY, F.when(single, F.col("only")).otherwise(F.col("mean")).alias("weighted_average"), "seconds_above", "gaps", flags.alias("flags"))


def shapes(facts: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, shape): the twelve numbers of shape() for the whole curve of each key, in the order of ts and row.

    Quantiles, slope and steps of the scaled values come from those of the raw ones by mean and deviation, so aggregates do."""
    w = Window.partitionBy(key).orderBy("ts", "row")
    rows = facts.select(key, F.col(value).alias("x"), (F.row_number().over(w) - 1).alias("i"), F.abs(F.col(value) - F.lag(value).over(w)).alias("step"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    x = rows.groupBy(key).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("s"), F.percentile("x", F.array(*map(F.lit, shares))).alias("q"), F.coalesce(F.regr_slope("x", "i"), F.lit(0.0)).alias("k"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("d"), F.coalesce(F.max("step"), F.lit(0.0)).alias("top"))
    unit = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    raw = F.concat(
        F.transform("q", lambda v: (v - F.col("m")) / unit),
        F.array(F.col("k") * (F.col("n") - 1) / unit, F.col("d") / unit, F.col("top") / unit, F.log(F.lit(1.0) + F.col("n")) / 10, F.col("s") / (F.abs("m") + F.col("s") + 1e-9)),
    )
    x = x.select(key, raw.alias("raw"))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda t, v: t + v * v))
    return x.select(key, F.transform("raw", lambda v: v / F.when(length > 0, length).otherwise(1.0)).alias("shape"))


def sampling(facts: DataFrame) -> DataFrame:
    """For each series: order of rows, repeated instants, median spacing of distinct instants, whether it is irregular."""
    us = F.unix_micros("ts")
    by_row, by_time = (Window.partitionBy(*KEY).orderBy(c) for c in ("row", "ts"))
    steps = facts.select(*KEY, (us - F.lag(us).over(by_row)).alias("_d"), (us - F.lag(us).over(by_time)).alias("_s"))
    apart = F.when(F.col("_s") > 0, F.col("_s") / 1e6)  # a step between distinct instants
    order = F.when(F.coalesce(F.bool_and(F.col("_d") >= 0), F.lit(True)), "ascending").when(F.bool_and(F.col("_d") <= 0), "descending").otherwise("unsorted")
    found = steps.groupBy(*KEY).agg(order.alias("row_order"), F.count_if(F.col("_s") == 0).alias("repeats"), F.percentile(apart, 0.5).alias("median_seconds"), F.max(apart).alias("_most"), F.min(apart).alias("_least"))
    far = F.greatest(F.col("_most") - F.col("median_seconds"), F.col("median_seconds") - F.col("_least"))
    return found.withColumn("irregular", F.coalesce(far > F.greatest(F.lit(1.0), 0.1 * F.abs("median_seconds")), F.lit(False))).drop("_most", "_least")


def windows_of(facts: DataFrame, size: int = 200) -> DataFrame:
    """Runs of size samples of each series: first, last, change, extremes, mean and trend (1 % counts as stable)."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("ts", "row"))
    order = F.struct("ts", "row")
    x = facts.withColumn("part", F.floor((place - 1) / size).cast("long")).groupBy(*KEY, "part").agg(
        F.count("value").alias("n"), F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("_s")
    )
    change = F.col("last_value") - F.col("first_value")
    relative = change / F.greatest(F.abs("first_value"), F.abs("last_value"), F.col("_s"), F.lit(1e-12))
    trend = F.when(F.abs(relative) < 0.01, "stable").when(relative > 0, "rising").otherwise("falling")
    return x.withColumns({"change": change, "trend": F.when(F.col("n") > 1, trend)}).drop("_s")


def segments(facts: DataFrame, times: bool = False) -> DataFrame:
    """Overlapping windows of each series: as long as the series, from 8 to 128, half overlapping, the last flush right.

    Each sample is sent to the windows that it falls in, at most four, so that no row holds a whole series."""
    w = Window.partitionBy(*KEY)
    x = facts.withColumns({"i": F.row_number().over(w.orderBy("ts", "row")) - 1, "n": F.count(F.lit(1)).over(w).cast("int")})
    width = F.least(F.lit(128), F.greatest(F.lit(8), F.col("n")))
    x = x.withColumns({"width": width, "stride": F.floor(width / 2).cast("int"), "last": F.greatest(F.lit(0), F.col("n") - width)})
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - F.col("width") + 1) / F.col("stride")).cast("int"))
    to = F.least(F.floor(F.col("i") / F.col("stride")), F.floor(F.col("last") / F.col("stride"))).cast("int")
    own = F.when(first <= to, F.transform(F.sequence(first, F.greatest(first, to)), lambda k: k * F.col("stride"))).otherwise(F.array().cast("array<int>"))
    right = F.when(F.col("i") >= F.col("last"), F.array("last")).otherwise(F.array().cast("array<int>"))
    x = x.withColumn("start", F.explode(F.array_distinct(F.concat(own, right))))
    curve = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"])
    ends = [F.min("ts").alias("first_at"), F.max("ts").alias("last_at")] if times else []
    return x.groupBy(*KEY, "start").agg(curve.alias("values"), *ends).withColumn("start", F.col("start").cast("int"))


QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: the parameter of a function over a list of one isn't copied by the optimizer."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(v), F.lit(1))


def _quantile(ordered: Column, q: float) -> Column:
    """Between the two nearest of the ordered values."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    return F.get(ordered, low) + (F.get(ordered, F.least(low + 1, F.size(ordered) - 1)) - F.get(ordered, low)) * (at - low)


def shape(values: Column) -> Column:
    """Twelve numbers for the form of a curve, as a vector of length one; zeros for an empty curve.

    They are seven quantiles of the standardised values, their slope over the unit interval, the mean and the largest
    step, the length, and the share of the spread in spread and mean."""
    n = F.size(values)

    def of(z: Column, mean: Column, spread: Column) -> Column:
        # positions i / (n - 1) have mean 1 / 2 and squares that sum to n (n + 1) / (12 (n - 1)) around it
        lean = F.aggregate(F.transform(z, lambda v, i: v * (i / F.greatest(n - 1, F.lit(1)) - 0.5)), F.lit(0.0), lambda s, v: s + v)
        slope = F.when(n > 1, lean * 12 * (n - 1) / (n * (n + 1))).otherwise(0.0)
        steps = F.zip_with(F.slice(z, F.lit(1), n - 1), F.slice(z, F.lit(2), n - 1), lambda a, b: F.abs(b - a))
        quantiles = _let(F.array_sort(z), lambda o: F.array(*[_quantile(o, q) for q in QUANTILES]))
        moves = _let(steps, lambda d: F.array(_mean(d), F.coalesce(F.array_max(d), F.lit(0.0))))
        return F.concat(quantiles, F.array(slope), moves, F.array(F.log1p(n) / 10, spread / (F.abs(mean) + spread + 1e-9)))

    scaled = lambda v, m, s: F.transform(v, lambda x: (x - m) / F.when(s > 0, s).otherwise(1.0))
    spread = lambda v, m: F.sqrt(_mean(F.transform(v, lambda x: (x - m) * (x - m))))
    numbers = _let(_mean(values), lambda m: _let(spread(values, m), lambda s: _let(scaled(values, m, s), lambda z: of(z, m, s))))
    return F.when(n > 0, _let(numbers, V.unit)).otherwise(F.array_repeat(F.lit(0.0), 12))


def warped_distance(a: np.ndarray, b: np.ndarray, band: float = 0.15) -> float:
    """Dynamic time warping of standardised curves inside a band, divided by the longer length.

    Cells of one antidiagonal don't depend on each other, so each is one vector operation."""
    a, b = (np.asarray(x, float) for x in (a, b))
    a, b = ((x - x.mean()) / (x.std() or 1.0) for x in (a, b))
    n, m = len(a), len(b)
    width = max(abs(n - m), int(max(n, m) * band), 1)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        i = i[np.abs(2 * i - s) <= width]
        j = s - i
        cost[i, j] = np.abs(a[i - 1] - b[j - 1]) + np.minimum(np.minimum(cost[i - 1, j], cost[i, j - 1]), cost[i - 1, j - 1])
    return float(cost[n, m] / max(n, m))


def similar_curves(pieces: DataFrame, query: list[float], k: int = 8) -> DataFrame:
    """The k segments nearest to a curve: by the cosine of shapes, a bounded number of them, then by warped distance."""
    recall = min(max(10 * k, 50), 200)
    spark = pieces.sparkSession
    wanted = spark.createDataFrame([([float(x) for x in query],)], "values array<double>").select(shape(F.col("values"))).first()[0]

    def by_warp(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["distance"] = [warped_distance(v, np.array(query)) for v in b["values"]]
            yield b

    rows = pieces.select("entity", "metric", "start", F.col("values").cast("array<double>").alias("values"))
    near = rows.withColumn("cosine", V.dot(shape(F.col("values")), F.array(*map(F.lit, wanted))))
    near = near.orderBy(F.desc("cosine"), "entity", "metric", "start").limit(recall)
    schema = "entity long, metric string, start int, values array<double>, cosine double, distance double"
    return near.mapInPandas(by_warp, schema).orderBy("distance", "entity", "metric", "start").limit(k)


def guarded(facts: DataFrame, single: bool) -> Column:
    """Why a calculation over these facts is refused; first reason first, null if none."""
    return (
        F.when(F.lit(single) & (F.count_distinct("entity", "metric") > 1), "TARGET_ENTITY_REQUIRED")
        .when(F.count_if(F.col("flag") == "SOURCE_TIMEZONE_UNSPECIFIED") > 0, "NEEDS_TIMEZONE_MAPPING")
        .when(F.count_if(F.col("flag") == "DUPLICATE_SAMPLE_CONFLICT") > 0, "EVIDENCE_CONFLICT")
        .when((F.count_if(F.col("flag") == "UNIT_RANGE") > 0) | (F.count_distinct("unit") > 1), "NEEDS_UNIT_MAPPING")
        .when(F.count(F.lit(1)) == 0, "NO_DATA")
    )


def run(plan, facts: DataFrame) -> DataFrame:
    """A plan's time-series operation over facts(entity, metric, ts, value, row)."""
    rows = facts.where(F.col("metric") == plan.metric) if plan.metric else facts
    if plan.target_entity is not None:
        rows = rows.where(F.col("entity").cast("string") == plan.target_entity)
    period = (plan.time_range.start, plan.time_range.end) if plan.time_range else None
    name = plan.operation_of("timeseries")
    if name in ("time_weighted_average", "duration_above"):
        return interval_statistics(rows.withColumn("selected", F.lit(True)), *period, threshold=plan.threshold if plan.threshold is not None else Decimal(plan.threshold_expression or 0))
    if name == "compare_periods":
        return compared_periods(rows, period, (plan.compare_time_range.start, plan.compare_time_range.end))
    if name == "similar_shape":
        return similar_curves(segments(rows), plan.query_series, plan.top_k)
    rows = rows.where(in_range(F.col("ts"), *period, closed=plan.time_range.closed)) if period else rows
    if name.startswith("trend_"):
        return trends(rows).select(*KEY, {"trend_start_end": "start_end", "trend_regression": "slope", "trend_monotonic": "monotonic"}[name])
    if name == "search":
        return rows.groupBy(*KEY).agg(F.count("value").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")).orderBy(*KEY).limit(plan.top_k)
    return totals(rows)
