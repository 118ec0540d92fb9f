"""Aggregates and interval statistics in exact rationals."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rationals as R
from ..functions.units import rational
from .timeseries import KEY, intervals

TOTALS = ("sum", "min", "max", "average")


def _finished(found: DataFrame, keys: list[str], schema: str, of: Callable[[dict], dict]) -> DataFrame:
    """found, a row for each key, with the columns of(row) in place of those that aren't keys."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name in keys)
    kinds = {"double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
    names = {n: kinds[k] for n, k in (x.split() for x in schema.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [of(r) for r in b.to_pylist()]
            made = [pa.array([r[n] for r in rows], kind) for n, kind in names.items()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keys], *made], [*keys, *names])

    return found.select(*keys, *[c for c in found.columns if c not in keys]).mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def exact_totals(df: DataFrame, number: Column, keys: list[str] | None = None, unit: Column | None = None, target: str | None = None) -> DataFrame:
    """For each key: matched, numbers, excluded, status, and sum, min, max and average as rationals (see serialised()).

    number is the text of a number as its source has it; nulls and other texts are excluded. Numbers of up to 18 digits on
    each side of the point are summed as decimals, others as limbs by place, so that a hot key is added up in all tasks; the few sums of a key meet in one row. Numbers of other units are
    taken into target by exact factors: a unit that doesn't convert gives UNIT_UNKNOWN or UNIT_INCOMPATIBLE, and a number of
    more than 4096 digits or with such an exponent SOURCE_NUMERIC_PRECISION_LIMIT, instead of totals. Without a key there is
    one row, also of an empty table."""
    keys = keys or []
    rows = df.select(*keys, number.cast("string").alias("_t"), (F.lit(None).cast("string") if unit is None else unit).alias("_u")).withColumn("_d", R.plain(F.col("_t")))
    other = F.col("_d").isNull() & R.is_number(F.col("_t"))
    rows = rows.withColumn("_t", F.when(other, F.col("_t"))).withColumn("_beyond", F.when(F.col("_t").isNotNull(), ~R.in_budget(F.col("_t"))).otherwise(False))
    cut = F.when(F.col("_t").isNotNull() & ~F.col("_beyond"), R.limbs(F.col("_t")))
    each = rows.select(*keys, "_t", "_d", "_u", "_beyond", F.posexplode_outer(cut).alias("_i", "_l"))
    first = F.coalesce(F.col("_i"), F.lit(0)) == 0  # once for each row
    lead = F.when(first & ~F.col("_beyond"), F.col("_t"))
    order = F.when(lead.isNotNull(), R.order_key(lead))
    whole = F.floor("_d")
    sums = each.groupBy(*keys, "_u", F.col("_l.place").alias("place")).agg(
        F.sum(F.col("_l.limb").cast("decimal(20,0)")).alias("s"), F.sum(whole.cast("decimal(20,0)")).alias("whole"), F.sum((F.col("_d") - whole).cast("decimal(19,18)")).alias("part"),
        F.count_if(first).alias("matched"), F.count_if(first & (F.col("_t").isNotNull() | F.col("_d").isNotNull())).alias("numbers"), F.count_if("_beyond").alias("beyond"),
        F.min("_d").cast("string").alias("low"), F.max("_d").cast("string").alias("high"), F.min_by(lead, order).alias("least"), F.max_by(lead, order).alias("most"),
    )
    kept = ("place", "s", "whole", "part", "matched", "numbers", "beyond", "low", "high", "least", "most")
    found = sums.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_u").alias("unit"), *kept)).alias("parts"))

    def of(row: dict) -> dict:
        parts = row["parts"]
        out = {n: int(sum(p[n] for p in parts)) for n in ("matched", "numbers")}
        status, by_unit, ends, total = "OK", defaultdict(list), [], Fraction(0)
        for p in parts:
            if p["numbers"] or p["s"] is not None:  # a place, or what has none
                by_unit[p["unit"]].append(p)
        for u, ps in by_unit.items():
            how = (Fraction(1), Fraction(0)) if target is None else rational(u, target) if u else None
            if how is None:
                status = "UNIT_INCOMPATIBLE" if u else "UNIT_UNKNOWN"
                continue
            plain = sum((Fraction(x) for p in ps for x in (p["whole"], p["part"]) if x is not None), Fraction(0))
            total += how[0] * (plain + R.total([(p["place"], p["s"]) for p in ps if p["s"] is not None])) + how[1] * sum(p["numbers"] for p in ps)
            ends += [Fraction(t.strip()) * how[0] + how[1] for p in ps for t in (p["low"], p["high"], p["least"], p["most"]) if t is not None]
        if any(p["beyond"] for p in parts):
            status = "SOURCE_NUMERIC_PRECISION_LIMIT"
        if status == "OK" and target is None and len({p["unit"] for p in parts if p["numbers"]}) > 1:
            status = "NEEDS_UNIT_MAPPING"
        good = status == "OK" and out["numbers"] > 0
        values = (total, min(ends), max(ends), total / out["numbers"]) if good else (None,) * 4
        results = {n: R.serialised(v) for n, v in zip(TOTALS, values, strict=True)}
        if status != "OK":
            results = {n: r | {"status": status} for n, r in results.items()}
        return out | {"excluded": out["matched"] - out["numbers"], "status": status if status != "OK" or good else "NO_DATA"} | {f"{n}_{c}": v for n, r in results.items() for c, v in r.items()}

    schema = "matched long, numbers long, excluded long, status string, " + ", ".join(f"{n}_{c}" for n in TOTALS for c in R.RESULT.split(", "))
    return _finished(found, keys, schema, of)


def exact_interval_mean(facts: DataFrame, start: str, end: str, number: Column | None = None) -> DataFrame:
    """For each series the time-weighted mean over a window as a rational, and the seconds covered as a ratio.

    The same intervals and cuts as interval_statistics(). The mean is a sum of samples, each with a weight: half the
    microseconds of the intervals that it bounds, whole numbers, but where the window cuts an interval a fraction with that
    interval's length below the line. Limbs times numerators are summed by denominator, of which a series has three."""
    text = (F.col("value") if number is None else number).cast("string")
    x = intervals(facts.withColumn("_t", text), start, end)
    return _weighted(x)


def _weighted(x: DataFrame) -> DataFrame:
    span, cut = F.col("f") - F.col("b"), (F.col("b") > F.col("t")) | (F.col("f") < F.col("t2"))
    length = F.col("t2") - F.col("t")
    wide = lambda c: c.cast("decimal(20,0)")
    # the integral of a line from b to f: (f - b) / (2 L) x (v1 (2 t2 - b - f) + v2 (b + f - 2 t))
    first, second = wide(F.col("t2") - F.col("b") + F.col("t2") - F.col("f")), wide(F.col("b") - F.col("t") + F.col("f") - F.col("t"))
    sides = F.array(
        F.struct(F.col("value").cast("string").alias("v"), F.when(cut, wide(span) * first).otherwise(wide(span).cast("decimal(38,0)")).alias("w")),
        F.struct(F.col("value2").cast("string").alias("v"), F.when(cut, wide(span) * second).otherwise(wide(span).cast("decimal(38,0)")).alias("w")),
    )
    used = x.where(F.col("why").isNull())
    covered = used.groupBy(*KEY).agg(F.sum(span).alias("micros"))
    base = F.lit(10**R.LIMB)
    weights = F.array(*[F.struct(F.lit(i).alias("up"), (w % base).alias("w")) for i, w in enumerate((F.col("w"), F.expr(f"w div {10**R.LIMB}"), F.expr(f"w div {10 ** (2 * R.LIMB)}")))])
    each = used.select(*KEY, F.when(cut, length).otherwise(F.lit(1)).alias("den"), F.explode(sides).alias("side")).select(*KEY, "den", "side.*").select(*KEY, "den", F.explode(weights).alias("x"), R.limbs(F.col("v")).alias("limbs"))
    each = each.where("x.w > 0").select(*KEY, "den", "x.*", F.explode("limbs").alias("l"))
    sums = each.groupBy(*KEY, "den", (F.col("l.place") + F.col("up")).alias("place")).agg(F.sum(F.col("l.limb").cast("decimal(10,0)") * F.col("w").cast("decimal(10,0)")).alias("s"))
    found = sums.groupBy(*KEY).agg(F.collect_list(F.struct("den", "place", "s")).alias("parts")).join(covered, KEY)

    def of(row: dict) -> dict:
        by: defaultdict[int, list] = defaultdict(list)
        for p in row["parts"]:
            by[p["den"]].append((p["place"], p["s"]))
        area = sum((R.total(ps) / (2 * int(den)) for den, ps in by.items()), Fraction(0))
        seconds = Fraction(int(row["micros"]), 1_000_000)
        return {f"mean_{c}": v for c, v in R.serialised(area / int(row["micros"])).items()} | {"seconds_ratio": R.serialised(seconds)["ratio"]}

    schema = ", ".join(f"mean_{c}" for c in R.RESULT.split(", ")) + ", seconds_ratio string"
    return _finished(found.select(*KEY, "parts", "micros"), KEY, schema, of)


def guarded_counts(rows: DataFrame, start: str, end: str, unit: str | None = None, closed: bool = False) -> DataFrame:
    """For each series of a window: records, samples, records without a number, repeated samples, and why they can't be counted.

    rows has entity, metric, ts, number (text), unit, position (of the record in its source) and eligible. Records are
    rows, whatever they hold. Samples are distinct instants with a number: equal ones, whatever their digits look like,
    count once. The status is COUNTED, or the first that applies: two records at one position, a number that can't be
    calculated or is beyond 4096 digits, a unit other than the one asked for, or two numbers or units at one instant;
    then there are no samples."""
    inside = (F.col("ts") >= F.lit(start).cast("timestamp")) & ((F.col("ts") <= F.lit(end).cast("timestamp")) if closed else (F.col("ts") < F.lit(end).cast("timestamp")))
    text = F.when(R.is_number(F.col("number")), F.col("number"))
    x = rows.where(inside).select(*KEY, "ts", "position", "unit", text.alias("t"), (~F.col("eligible")).alias("blocked"))
    x = x.withColumns({"beyond": F.coalesce(~R.in_budget(F.col("t")), F.lit(False)), "other": F.col("t").isNotNull() & ~F.col("unit").eqNullSafe(F.lit(unit)) if unit else F.lit(False)})
    places = rows.groupBy(*KEY, "position").agg(F.count(F.lit(1)).alias("n")).groupBy(*KEY).agg(F.max("n").alias("most"))
    sign = F.when(F.col("t").isNotNull() & ~F.col("beyond"), F.struct(R.order_key(F.col("t")).alias("n"), F.coalesce("unit", F.lit("")).alias("u")))
    at = x.groupBy(*KEY, "ts").agg(
        F.count(F.lit(1)).alias("records"), F.count("t").alias("numbers"), (F.min(sign) != F.max(sign)).alias("conflict"),
        *[F.bool_or(c).alias(c) for c in ("blocked", "beyond", "other")], F.min(F.when(F.col("t").isNotNull(), F.coalesce("unit", F.lit("")))).alias("u0"), F.max(F.when(F.col("t").isNotNull(), F.coalesce("unit", F.lit("")))).alias("u1"),
    )
    found = at.groupBy(*KEY).agg(
        F.sum("records").alias("n_records"), F.count_if(F.col("numbers") > 0).alias("samples"), F.sum(F.col("records") - F.col("numbers")).alias("n_excluded"), F.sum(F.greatest(F.col("numbers") - 1, F.lit(0))).alias("n_repeats"),
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("blocked", "beyond", "other", "conflict")], F.min("u0").alias("u0"), F.max("u1").alias("u1"),
    ).join(places, KEY)
    status = F.when(F.col("most") > 1, "COUNT_DUPLICATE_PHYSICAL_ROW").when(F.col("blocked"), "COUNT_METRIC_NOT_CALCULABLE").when(F.col("beyond"), "COUNT_SOURCE_PRECISION_LIMIT").when(F.col("other"), "COUNT_MEASUREMENT_UNIT_MISMATCH").when(F.col("conflict"), "COUNT_DUPLICATE_SAMPLE_CONFLICT").otherwise("COUNTED")
    return found.withColumn("status", status).select(*KEY, "n_records", F.when(F.col("status") == "COUNTED", F.col("samples")).alias("n_samples"), "n_excluded", "n_repeats", F.when(F.col("u0") == F.col("u1"), F.nullif(F.col("u0"), F.lit(""))).alias("unit"), "status")
