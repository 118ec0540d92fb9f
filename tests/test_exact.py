"""Exact aggregates against Python's fractions."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodestone.functions import rationals as R
from lodestone.functions import units
from lodestone.operators import exact as E
from lodestone.operators import timeseries as T

TEXTS = ["1e30", "1e-30", "-1e30", "9007199254740993", "0.1", "0.2", " 7 ", "-0", "+.5", "5.", "00012.3400", "1E+2", "-123456789012345678901234567890.000000000987654321", "9" * 60, "-" + "9" * 45 + "e-20", "0e5", "1e400", "1e-400"]
OTHER = ["", "x", "1e", ".", "1_000", "NaN", "0x10", None, "--1", "1 2"]


def shown(x: Fraction) -> str:
    return str(x.numerator) if x.denominator == 1 else f"{x.numerator}/{x.denominator}"


def test_texts_as_limbs(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + OTHER)], "i int, t string")
    got = {r["i"]: r for r in rows.select("i", R.is_number(F.col("t")).alias("n"), F.when(R.is_number(F.col("t")), R.limbs(F.col("t"))).alias("l")).collect()}
    for i, t in enumerate(TEXTS + OTHER):
        assert got[i]["n"] == (i < len(TEXTS))
        if i < len(TEXTS):
            assert R.total([(x["place"], x["limb"]) for x in got[i]["l"]]) == Fraction(t.strip().rstrip(".") if t == "5." else t.strip())


def test_order(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").orderBy(R.order_key(F.col("t")))
    values = [Fraction(r["t"].strip()) for r in rows.collect()]
    assert values == sorted(values)


def test_totals(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice(TEXTS[:16] + OTHER)) for _ in range(600)] + [("one", "9007199254740993"), ("none", None), ("tiny", "1e-400"), ("huge", "1e400"), ("huge", "0.3")]
    df = spark.createDataFrame(rows, "k string, t string").repartition(5)
    got = {r["k"]: r for r in E.exact_totals(df, F.col("t"), ["k"]).collect()}
    for k in {r[0] for r in rows}:
        xs = [Fraction(t.strip()) for n, t in rows if n == k and t not in OTHER]
        r = got[k]
        assert (r["matched"], r["numbers"], r["excluded"]) == (sum(x[0] == k for x in rows), len(xs), sum(x[0] == k for x in rows) - len(xs))
        if xs:
            want = {"sum": sum(xs), "min": min(xs), "max": max(xs), "average": sum(xs) / len(xs)}
            assert {n: r[f"{n}_ratio"] for n in want} == {n: shown(v) for n, v in want.items()}
            assert r["sum_exact_value"] is None or Fraction(r["sum_exact_value"]) == want["sum"]
    assert got["one"]["sum_status"] == "INTEGER_PRECISION_SEE_EXACT_VALUE" and got["one"]["sum_value"] is None and got["one"]["sum_decimal_value"] == "9007199254740993"
    assert got["none"]["status"] == "NO_DATA" and got["none"]["sum_ratio"] is None
    assert got["tiny"]["sum_status"] == "UNDERFLOW_SEE_DECIMAL_VALUE" and got["huge"]["sum_status"] == "OVERFLOW_SEE_DECIMAL_VALUE"
    assert got["huge"]["min_value"] == 0.3


def test_thirds_are_rounded_as_text_only(spark):
    r = E.exact_totals(spark.createDataFrame([("1",), ("0",), ("0",)], "t string"), F.col("t")).first()
    assert r["average_ratio"] == "1/3" and r["average_rounded"] and r["average_exact_value"] is None and r["average_decimal_value"].startswith("0.3333333333")


def test_units_and_limits(spark):
    rows = [("a", "1", "h"), ("a", "1", "s"), ("b", "0", "C"), ("b", "1", "K"), ("c", "1", "kg"), ("d", "1", None), ("e", "1" * 5000, "s"), ("f", "x", "kg")]
    df = spark.createDataFrame(rows, "k string, t string, u string")
    got = {r["k"]: r for r in E.exact_totals(df, F.col("t"), ["k"], F.col("u"), "h").collect()}
    assert got["a"]["sum_ratio"] == "3601/3600" and got["a"]["min_ratio"] == "1/3600"
    assert [got[k]["status"] for k in "cdef"] == ["UNIT_INCOMPATIBLE", "UNIT_UNKNOWN", "SOURCE_NUMERIC_PRECISION_LIMIT", "NO_DATA"]
    kelvin = E.exact_totals(df.where("k = 'b'"), F.col("t"), None, F.col("u"), "K").first()
    assert kelvin["sum_exact_value"] == "274.15"
    assert E.exact_totals(df.where("k in ('a')"), F.col("t"), None, F.col("u")).first()["status"] == "NEEDS_UNIT_MAPPING"
    none = E.exact_totals(df.limit(0), F.col("t")).first()
    assert (none["matched"], none["status"], none["sum_status"]) == (0, "NO_DATA", "NO_DATA")


def test_records_of_small_numbers(spark):
    rows = [("4e-7", "kg", "0", "kg", False), ("4e-7", "kg", "0.0004", "g", True), ("1", "h", "3600", "s", True), ("0", "°C", "273.15", "K", True), ("1e30", "t", "1e33", "kg", True), ("x", "kg", "1", "kg", None), ("1", "kg", "1", "m", None), ("1", "stone", "1", "stone", None)]
    df = spark.createDataFrame([r[:4] for r in rows], "a string, ua string, b string, ub string")
    got = df.select(units.record_values_equal([(F.col("a"), F.col("ua")), (F.col("b"), F.col("ub"))]).alias("same")).collect()
    assert [r["same"] for r in got] == [r[4] for r in rows]


@pytest.mark.parametrize("window", [("1970-01-01T00:00:03Z", "1970-01-01T00:00:47Z"), ("1970-01-01T00:00:00Z", "1970-01-02T00:00:00Z"), ("1970-01-01T00:00:11Z", "1970-01-01T00:00:12.5Z")])
def test_interval_mean(spark, window):
    rng = random.Random(3)
    at, rows = 0, []
    for _ in range(40):
        rows.append((1, "m", at, rng.choice([0.1, 0.2, -7.25, 1e17, 1e-9]), True))
        at += rng.randint(1, 30) * 100_003
    df = spark.createDataFrame(rows, "entity int, metric string, us long, value double, selected boolean").withColumn("ts", F.timestamp_micros("us"))
    got = E.exact_interval_mean(df, *window).collect()
    low, high = (spark.range(1).select(F.unix_micros(F.lit(w).cast("timestamp"))).first()[0] for w in window)
    steps = sorted(b[2] - a[2] for a, b in zip(rows, rows[1:], strict=False))
    k = (len(steps) - 1) * 0.25
    q25 = steps[int(k)] + (k - int(k)) * (steps[min(int(k) + 1, len(steps) - 1)] - steps[int(k)])
    area = covered = Fraction(0)
    for (_, _, t, v, _), (_, _, t2, v2, _) in zip(rows, rows[1:], strict=False):
        b, f, v, v2 = max(t, low), min(t2, high), Fraction(str(v)), Fraction(str(v2))
        if f > b and t2 - t <= 3 * q25:
            line = lambda x: v + (v2 - v) * Fraction(x - t, t2 - t)  # noqa: B023, E731
            area += (line(b) + line(f)) * (f - b) / 2
            covered += f - b
    assert [(r["mean_ratio"], r["seconds_ratio"]) for r in got] == ([(shown(area / covered), shown(covered / 1_000_000))] if covered else [])
    near = T.interval_statistics(df, *window).first()
    assert not covered or near["weighted_average"] == pytest.approx(float(area / covered), rel=1e-6)


def test_guarded_counts(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    rows = [  # entity, second, number, unit, position, eligible
        ("fine", 0, "1.50", "m", 1, True), ("fine", 0, "+15e-1", "m", 2, True), ("fine", 1, None, None, 3, True), ("fine", 1, "x", "m", 4, True), ("fine", 2, "-0", "m", 5, True), ("fine", 2, "0.000", "m", 6, True), ("fine", 90, "1", "s", 7, True),
        ("value", 0, "1", "m", 1, True), ("value", 0, "1.0000000000000000000000001", "m", 2, True), ("unit", 0, "1", "m", 1, True), ("unit", 0, "1", None, 2, True), ("place", 0, "1", "m", 1, True), ("place", 1, "1", "m", 1, True),
        ("cell", 0, "1", "m", 1, False), ("long", 0, "1e5000", "m", 1, True), ("none", 0, None, "m", 1, True),
    ]
    df = spark.createDataFrame([(e, "x", at(s), n, u, p, ok) for e, s, n, u, p, ok in rows], "entity string, metric string, ts timestamp, number string, unit string, position int, eligible boolean")
    got = {r["entity"]: tuple(r)[2:] for r in E.guarded_counts(df, "2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z").collect()}
    assert got["fine"] == (6, 2, 2, 2, "m", "COUNTED") and got["none"] == (1, 0, 1, 0, None, "COUNTED")
    assert {k: got[k][-1] for k in ("value", "unit", "place", "cell", "long")} == {"value": "COUNT_DUPLICATE_SAMPLE_CONFLICT", "unit": "COUNT_DUPLICATE_SAMPLE_CONFLICT", "place": "COUNT_DUPLICATE_PHYSICAL_ROW", "cell": "COUNT_METRIC_NOT_CALCULABLE", "long": "COUNT_SOURCE_PRECISION_LIMIT"}
    asked = {r["entity"]: r["status"] for r in E.guarded_counts(df, "2024-01-01T00:00:00Z", "2024-01-01T00:01:30Z", "m", closed=True).collect()}
    assert asked["fine"] == "COUNT_MEASUREMENT_UNIT_MISMATCH" and asked["none"] == "COUNTED"
