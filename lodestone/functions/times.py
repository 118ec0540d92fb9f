"""Time values: ISO text, epochs and spreadsheet days; time columns; retry times."""

from __future__ import annotations

import re
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


ZONES = tuple(sorted(available_timezones()))


def instant(text: Column) -> Column:
    """ISO text as a timestamp; without a zone it counts as UTC (the session's zone); null if it is no time."""
    return F.try_to_timestamp(text)


def numeric_instant(value: Column) -> Column:
    """By magnitude: milliseconds from 1e11 on, seconds from 1e9 on, spreadsheet days from 20 000 to 80 000; else null."""
    v = value.cast("double")
    size = F.abs(v)
    micros = F.when(size >= 1e11, v * 1000).when(size >= 1e9, v * 1_000_000).when((size >= 20_000) & (size <= 80_000), (v - 25569) * 86_400_000_000)
    return F.timestamp_micros(F.round(micros).cast("long"))


#: From this share of times on, a column is one of times.
TIME_COLUMN = 0.75


def strict_clock(text: Column, zone: Column) -> Column:
    """ISO text as microseconds since 1970; a text without a zone takes the given one.

    Seconds may be missing. Null if neither names a zone, if the named one doesn't exist, if it is finer than microseconds, or if the local time doesn't exist or is ambiguous."""
    text = F.regexp_replace(text, r"([T ]\d\d:\d\d)((?:[Zz]|[+-]\d\d:?\d\d)?)$", "$1:00$2")
    zone = F.when(zone.isin("UTC", "Z", *ZONES) | zone.rlike(r"^[+-](0\d|1[0-7]):[0-5]\d$"), zone)
    fine = text.rlike(r"[T ]\d\d:\d\d:\d\d\.\d{6}0*[1-9]")
    own = text.rlike(r"([Zz]|[+-]\d\d:?\d\d)$")
    local = F.regexp_replace(text, r"(\.\d{6})\d+", "$1").try_cast("timestamp_ntz")
    hour = F.expr("INTERVAL 3 HOURS")
    utc = F.to_utc_timestamp(local.cast("timestamp"), zone)
    exists = F.from_utc_timestamp(utc, zone) == local.cast("timestamp")
    before, after = (F.unix_micros(F.to_utc_timestamp((local + sign).cast("timestamp"), zone)) for sign in (-hour, hour))
    shift = (after - before) - F.lit(6 * 3_600_000_000)  # what the zone's offset loses from three hours before to three after
    other = F.timestamp_micros(F.unix_micros(utc) + shift)
    twin = F.timestamp_micros(F.unix_micros(utc) - shift)
    twice = (shift != 0) & ((F.from_utc_timestamp(other, zone) == local.cast("timestamp")) | (F.from_utc_timestamp(twin, zone) == local.cast("timestamp")))
    placed = F.when(zone.isNotNull() & exists & ~twice, F.unix_micros(utc))
    return F.when(~fine & own, F.unix_micros(F.try_to_timestamp(text))).when(~fine, placed)


def time_share(column: Column) -> Column:
    """Share of the filled values that are times; a column of 0.75 or more is a time column."""
    return F.count_if(instant(column).isNotNull()) / F.greatest(F.count_if(F.coalesce(F.trim(column), F.lit("")) != ""), F.lit(1))


def seconds(t: Column) -> Column:
    return F.unix_micros(t) / F.lit(1e6)


def retry_at(t: Column, attempts: Column, base: int = 30, top: int = 6) -> Column:
    """t plus base seconds doubled for each attempt, at most top times."""
    return F.timestamp_micros(F.unix_micros(t) + (F.lit(base * 1_000_000) * F.pow(F.lit(2), F.least(attempts, F.lit(top)))).cast("long"))


DATED = r"(?<!\d)\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?(?!\d)"
DATE, CHINESE_DATE = r"(?<!\d)\d{4}-\d\d-\d\d(?!\d)", r"(?<!\d)\d{4}年\d{1,2}月\d{1,2}日(?!\d)"
CLOCK = r"(?<![A-Za-z0-9:+-])\d{1,2}:\d\d(?::\d\d(?:\.\d+)?)?(?!\d)"


def literals(text: Column) -> Column:
    """The times that a text names, sorted and distinct, each as kind and value: 'datetime 2024-01-02T03:04+00:00', 'date 2024-01-02', 'clock 03:04'.

    Whole timestamps are taken first, then dates, also Chinese ones, then clocks. A timestamp names its date and its clock
    too, a clock with seconds the one without. What no calendar or clock has is none."""
    found = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    rest = F.regexp_replace(text, DATED, " ")
    stamps = F.transform(found(text, DATED), lambda x: F.regexp_replace(F.concat(F.substring(x, 1, 10), F.lit("T"), F.substring(x, 12, 40)), "[Zz]$", "+00:00"))
    stamps = F.filter(stamps, lambda x: F.substring(x, 1, 10).try_cast("date").isNotNull() & _clock_ok(F.substring(x, 12, 8)))
    padded = lambda x, i: F.lpad(F.regexp_extract(x, r"(\d+)年(\d+)月(\d+)日", i), 2, "0")
    chinese = F.transform(found(F.regexp_replace(rest, DATE, " "), CHINESE_DATE), lambda x: F.concat_ws("-", F.substring(x, 1, 4), padded(x, 2), padded(x, 3)))
    days = F.filter(F.concat(found(rest, DATE), chinese, F.transform(stamps, lambda x: F.substring(x, 1, 10))), lambda x: x.try_cast("date").isNotNull())
    bare = F.regexp_replace(F.regexp_replace(rest, DATE, " "), CHINESE_DATE, " ")
    clocks = F.filter(F.transform(found(bare, CLOCK), lambda x: F.when(x.rlike(r"^\d:"), F.concat(F.lit("0"), x)).otherwise(x)), _clock_ok)
    clocks = F.concat(clocks, F.transform(stamps, lambda x: F.regexp_extract(x, r"T(\d\d:\d\d(?::\d\d(?:\.\d+)?)?)", 1)))
    clocks = F.concat(clocks, F.transform(clocks, lambda x: F.substring(x, 1, 5)))
    of = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{kind} "), x))
    return F.array_sort(F.array_distinct(F.concat(of("datetime", stamps), of("date", days), of("clock", clocks))))


def _clock_ok(x: Column) -> Column:
    return x.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d|$|[^:\d])")


# Shares and weights of the older choice of a time column, and names that speak for one.
OLDER_SHARE, OLDER_WEIGHT, NAME_BONUS, TIME_NAME = 0.6, 0.8, 0.25, r"(?i)(time|date|timestamp|时间|日期)"


def older_time_column(df: DataFrame) -> tuple[str | None, float]:
    """The column that the older rule takes for the time, and its score; (None, 0.0) if there is none.

    A column scores 0.8 of the share of its filled values that are times, and 0.25 for its name, at most 1; it needs a share
    of 0.6, and numbers a name. The first of equal ones is taken. All columns are counted in one pass."""
    tests, names = [], []
    for f in df.schema.fields:
        number, named = isinstance(f.dataType, T.NumericType), re.search(TIME_NAME, f.name) is not None
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.BooleanType, T.VariantType)) or number and not named:
            continue
        column = F.col(f"`{f.name}`")
        at = numeric_instant(column) if number else instant(column.cast("string"))
        tests.append((F.count(at) / F.greatest(F.count(column), F.lit(1))).alias(f"c{len(names)}"))
        names.append((f.name, NAME_BONUS if named else 0.0))
    best = (None, 0.0)
    for (name, bonus), share in zip(names, df.agg(*tests).first() if tests else [], strict=True):
        score = min(1.0, OLDER_WEIGHT * share + bonus)
        if share >= OLDER_SHARE and score > best[1]:
            best = (name, score)
    return best
