"""Data-quality checks: each gives how many cases it measured and how many passed; a score sums them up.

Without a declaration a rule is NOT_ASSESSED, never passed."""

from __future__ import annotations

from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUES, ZONES = 100, tuple(sorted(available_timezones()))
# Units that a data dictionary may declare.
KNOWN_UNITS = (
    "1 % mm cm m km m2 m² m3 m³ mm2 mm3 L l ml mL kg g t s ms min h d day Hz kHz rpm Pa kPa MPa bar N N·m Nm J kJ W kW Wh kWh V A mA Ω kΩ ohm ℃ °C C K mm/s "
    "件 台 个 套 箱 片 元 CNY RMB 万元 元/件 元/台 人 次 无量纲 通过计数"
).split()


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def _finite(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


#: How a declared type reads a text; names that stand for the same type share a line.
READS = {
    "string str text": lambda t: F.lit(True),
    "int integer int64": lambda t: F.coalesce(_finite(t) == F.floor(_finite(t)), F.lit(False)),
    "number float float64 double numeric": lambda t: _finite(t).isNotNull(),
    "bool boolean": lambda t: F.lower(t).isin("true", "false", "0", "1"),
    "array list": lambda t: F.schema_of_variant(F.try_parse_json(t)).startswith("ARRAY") & t.rlike(r"^\s*\["),
    "object dict": lambda t: F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT") & t.rlike(r"^\s*\{"),
    "null": lambda t: F.lower(F.trim(t)) == "null",
}
READS = {name: read for names, read in READS.items() for name in names.split()}


def has_type(text: Column, declared: str) -> Column:
    """Whether text can be read as one of the declared types, joined by |; blank fits any; null if none is known.

    Dates and timestamps are checked by time_ok."""
    names = [n.strip() for n in declared.split("|")]
    known = [READS.get(n, (lambda t: F.lit(True)) if n.startswith(("date", "timestamp")) else None) for n in names]
    tests = [F.coalesce(read(text), F.lit(False)) for read in known if read]
    return blank(text) | reduce(lambda a, b: a | b, tests) if tests else F.when(blank(text), F.lit(True))


def null_ok(value: Column, nullable: Column, explanation: Column) -> Column:
    """A null is fine where it may be, and a field that may be null must say what null means."""
    return F.when(nullable, ~blank(explanation)).otherwise(~blank(value))


def zone_ok(zone: Column) -> Column:
    """Whether a declared time zone exists; null if none is declared."""
    offset = zone.rlike(r"^[+-]([01]\d|2[0-3]):[0-5]\d$")
    return F.when(~blank(zone), F.coalesce(offset | zone.isin("Z", *ZONES), F.lit(False)))


#: A time of day, with a zone of its own or without.
CLOCK = r"^\d{4}-\d\d-\d\d[T ]\d\d(:?\d\d(:?\d\d([.,]\d{1,6})?)?)?"
OWN_ZONE = r"([Zz]|[+-]\d\d:?\d\d)$"
DAYS = ("date", "day", "daily", "日期", "日")


def time_ok(text: Column, zone: Column, grain: Column) -> Column:
    """Whether text is a time; null, not assessed, if it has no zone and none is declared.

    A declared zone that doesn't exist is wrong whatever the text. A blank text is fine. Where days are declared, or no
    granularity is and the text is a day, the text must be a day and needs no zone."""
    known, t = zone_ok(zone), F.trim(text)
    day = t.rlike(r"^\d{4}-\d\d-\d\d$")
    by_day = F.coalesce(grain.isin(*DAYS), F.lit(False)) | (blank(grain) & day)
    date = F.coalesce(day & t.try_cast("date").isNotNull(), F.lit(False))
    own = t.rlike(CLOCK + OWN_ZONE)
    at = F.coalesce((day | t.rlike(CLOCK + OWN_ZONE[:-1] + "?$")) & F.substring(t, 1, 10).try_cast("date").isNotNull() & (F.try_to_timestamp(_with_minutes(t)).isNotNull() | day), F.lit(False))
    return F.when(known == F.lit(False), False).when(blank(text), True).when(by_day, date).when(~at, False).when(own, True).otherwise(known)


def _with_minutes(t: Column) -> Column:
    """A clock that stops at hours or minutes, with zeros for the rest."""
    return F.regexp_replace(F.regexp_replace(t, r"([T ]\d\d)((?:[Zz]|[+-]\d\d:?\d\d)?)$", "$1:00$2"), r"([T ]\d\d:\d\d)((?:[Zz]|[+-]\d\d:?\d\d)?)$", "$1:00$2")


def coverage(seen: DataFrame, declared: DataFrame) -> DataFrame:
    """Fields that were seen but not declared, and the other way round."""
    return seen.exceptAll(declared).withColumn("problem", F.lit("OBSERVED_NOT_DECLARED")).unionByName(declared.exceptAll(seen).withColumn("problem", F.lit("DECLARED_NOT_OBSERVED")))


def declarations(published: DataFrame, requested: DataFrame) -> DataFrame:
    """(field, published, requested, verdict, effective): what is published holds, whatever a request says."""
    p, r = F.col("published"), F.col("requested")
    verdict = F.when(p.isNull(), "NOT_PUBLISHED").when(r.isNull(), "NOT_REQUESTED").when(p != r, "CONFLICT").otherwise("SAME")
    return published.join(requested, "field", "full").select("field", "published", "requested", verdict.alias("verdict"), F.coalesce(p, r).alias("effective"))


def check(df: DataFrame, rule: str, ok: Column, issue: Column, critical: bool = False) -> DataFrame:
    """One row for a rule over all rows of df: status, cases, passed, how many aren't assessed, and the first issues in order.

    A case whose test is null isn't assessed: it neither passes nor fails. The rule is NOT_ASSESSED if there are no others."""
    found = df.select(ok.alias("ok"), issue.cast("string").alias("issue"))
    top = found.where("not ok").select(F.lit(rule).alias("rule"), "issue").orderBy("issue").limit(ISSUES).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("issue")), ",").alias("issues"))
    sums = found.agg(F.count("ok").alias("denominator"), F.count_if("ok").alias("passed"), F.count_if(F.col("ok").isNull()).alias("unassessed"))
    row = sums.withColumn("rule", F.lit(rule)).join(top, "rule", "left")
    status = F.when(F.col("passed") < F.col("denominator"), "FAIL").when(F.col("denominator") > 0, "PASS").when(F.col("unassessed") > 0, "NOT_ASSESSED").otherwise("NOT_APPLICABLE")
    return row.select("rule", status.alias("status"), F.lit(critical).alias("critical"), "denominator", "passed", (F.col("denominator") - F.col("passed")).alias("n_issues"), "unassessed", F.coalesce("issues", F.lit("")).alias("issues"))


def not_assessed(df: DataFrame, rule: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.sparkSession.range(1).select(F.lit(rule).alias("rule"), F.lit("NOT_ASSESSED").alias("status"), F.lit(False).alias("critical"), zero.alias("denominator"), zero.alias("passed"), zero.alias("n_issues"), zero.alias("unassessed"), F.lit("").alias("issues"))


def key_check(df: DataFrame, key: list[str], row: str) -> DataFrame:
    """Primary key present and unique: each later row with the same key names the first row that has it.

    First rows are found by an aggregate and joined back, so that a key that very many rows share is split where Spark splits
    a skewed join; rows whose key is null or blank are wrong for that, whatever else has it."""
    rows = df.select(*key, F.col(row).alias("_row"))
    first = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min("_row").alias("_first"))
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(first[f"_k{i}"]) for i, k in enumerate(key)])
    filled = reduce(lambda a, b: a & b, [~blank(F.col(k)) for k in key])
    return check(rows.join(first, same), "primary_key", filled & (F.col("_row") == F.col("_first")), F.concat_ws(":", F.col("_row"), F.col("_first")), True)


def reference_check(df: DataFrame, field: str, target: DataFrame, target_field: str, nullable: bool = True) -> DataFrame:
    known = target.select(F.col(target_field).alias("_t")).distinct()
    rows = df.join(known, F.col(field) == F.col("_t"), "left")
    ok = F.col("_t").isNotNull() | (blank(F.col(field)) & F.lit(nullable))
    return check(rows, "reference", ok, F.col(field), True)


def scored(checks: DataFrame) -> DataFrame:
    """100 * passed / measured over rules that were assessed, blocking failures, and the verdict."""
    measured = F.col("status").isin("PASS", "FAIL")
    x = checks.agg(
        F.sum(F.when(measured, F.col("denominator"))).alias("measured"),
        F.sum(F.when(measured, F.col("passed"))).alias("passed"),
        F.count_if(F.col("critical") & ~F.col("status").isin("PASS", "NOT_APPLICABLE")).alias("blocking"),
        F.count_if((F.col("status") == "NOT_ASSESSED") | (F.col("unassessed") > 0)).alias("unassessed"),
    )
    verdict = F.when((F.col("blocking") > 0) | (F.col("passed") < F.col("measured")), "FAILED").when(F.col("unassessed") > 0, "PARTIAL").otherwise("PASSED")
    return x.select("measured", "passed", "blocking", "unassessed", F.round(100 * F.col("passed") / F.col("measured"), 4).alias("score"), verdict.alias("verdict"))
