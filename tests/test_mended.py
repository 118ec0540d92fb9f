"""Cases that went wrong once: guards, gaps, zones, numbers beyond doubles, deep records, curves of one sample."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.functions import records as J
from lodestone.functions import times
from lodestone.functions.predicates import Condition, variant_matches
from lodestone.operators import quality as Q
from lodestone.operators import snapshot as N
from lodestone.operators import timeseries as T
from lodestone.sources import readers


def test_the_guard_comes_before_statistics(spark, tmp_path):
    """The row group of the bad cell could be pruned by the test on q; the query has to fail all the same."""
    rows = spark.range(200_000).select("id", F.when(F.col("id") == 7, 50.0).otherwise(F.col("id") / 1000).alias("q"), (F.col("id") != 7).alias("ok"), (F.col("id") % 2).alias("kind"))
    rows.repartitionByRange(4, "id").write.option("parquet.block.size", 100_000).parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    with pytest.raises(PySparkException, match="SOURCE_CELL_NOT_CALCULABLE"):
        N.uncalculable_guarded(t, [F.col("kind") == 1], F.col("q") > 100.0, F.col("ok")).count()
    assert N.uncalculable_guarded(t, [F.col("kind") == 0], F.col("q") > 100.0, F.col("ok")).count() == 49_999
    assert "GreaterThan(q" not in N.uncalculable_guarded(t, [F.col("kind") == 0], F.col("q") > 100.0, F.col("ok"))._jdf.queryExecution().toString()


def series(spark, rows):
    at = lambda s: dt.datetime(2024, 1, 6, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    return spark.createDataFrame([(e, "m", at(s), v, i) for i, (e, s, v) in enumerate(rows)], "entity string, metric string, ts timestamp, value double, row long")


def test_older_rule(spark):
    facts = series(spark, [("gap", s, v) for s, v in ((0, 1.0), (10, 3.0), (20, 3.0), (30, 60.0), (200, 0.0))] + [("one", 5, 7.0)] + [("even", s, 60.0) for s in (0, 10, 20)])
    got = {r["entity"]: (r["weighted_average"], r["seconds_above"], r["gaps"], r["flags"]) for r in T.legacy_statistics(facts, "2024-01-06T00:00:00Z", "2024-01-07T00:00:00Z", 50.0).collect()}
    assert got == {"gap": ((20 + 30 + 315) / 30, 0.0, 1, "GAPS_EXCLUDED"), "one": (7.0, 0.0, 0, "TIME_WEIGHTING_UNDETERMINED"), "even": (60.0, 20.0, 0, "")}


def test_shapes_by_aggregates(spark):
    rng = np.random.default_rng(1)
    curves = {"a": rng.normal(size=50), "b": np.full(4, 2.0), "c": np.array([3.0]), "d": np.arange(9.0)}
    got = {r["entity"]: r["shape"] for r in T.shapes(series(spark, [(k, i, float(x)) for k, xs in curves.items() for i, x in enumerate(xs)]), "entity").collect()}
    for k, x in curves.items():
        m, s = x.mean(), x.std()
        z = (x - m) / (s or 1.0)
        d = np.abs(np.diff(z))
        slope = np.polyfit(np.linspace(0, 1, len(x)), z, 1)[0] if len(x) > 1 else 0.0
        v = np.array([*np.quantile(z, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]), slope, d.mean() if len(d) else 0, d.max() if len(d) else 0, math.log1p(len(x)) / 10, s / (abs(m) + s + 1e-9)])
        assert got[k] == pytest.approx(v / np.linalg.norm(v), abs=1e-9)


TIMES = [
    ("10:00", None, None, False), ("2024-01-01T10:00", None, None, None), ("2024-01-01T10:00", "Asia/Shanghai", None, True), ("2024-01-01T10:00Z", None, None, True),
    ("2024-01-01", None, None, True), ("2024-13-01", None, "day", False), ("2024-01-01T10:00Z", None, "day", False), ("2024-01-01T10:00:30Z", None, "minute", True),
    ("2024-01-01", None, "second", None), (" ", None, None, True), ("x", "Mars/Olympus", None, False), (" ", "+25:00", None, False), ("2024-01-01T10:00:00.123+08:00", None, None, True), ("2024-02-30T10:00Z", None, None, False),
]


def test_times_without_a_zone_are_not_assessed(spark):
    df = spark.createDataFrame([(i, *t[:3]) for i, t in enumerate(TIMES)], "i int, t string, z string, g string")
    assert [r[0] for r in df.orderBy("i").select(Q.time_ok(F.col("t"), F.col("z"), F.col("g"))).collect()] == [t[3] for t in TIMES]
    row = Q.check(df, "time", Q.time_ok(F.col("t"), F.col("z"), F.col("g")), F.col("i")).first()
    assert (row["status"], row["denominator"], row["passed"], row["unassessed"]) == ("FAIL", 12, 6, 2)
    assert Q.check(df.where("i = 1"), "time", Q.time_ok(F.col("t"), F.col("z"), F.col("g")), F.col("i")).first()["status"] == "NOT_ASSESSED"
    assert Q.check(df.limit(0), "time", F.lit(True), F.col("i")).first()["status"] == "NOT_APPLICABLE"


def test_numbers_of_records_beyond_doubles(spark):
    texts = ['{"n":9007199254740992}', '{"n":9007199254740993}', '{"n":0.1}', '{"n":0.10000000000000000001}', '{"n":1e2}', '{"n":100}', '{"n":"100"}', '{"n":true}', '{"n":123456789012345678901234567890}', "{\"it's\":1}", '{"n":[9007199254740993]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("r", F.parse_json("t"))
    found = lambda *c: [r["t"] for r in df.where(variant_matches(F.col("r"), Condition(*c))).collect()]
    assert found("n", "eq", 9007199254740993) == [texts[1]] and found("n", "gt", 9007199254740992) == [texts[1], texts[8]]
    assert found("n", "eq", 0.1) == [texts[2]] and found("n", "eq", 100) == [texts[4], texts[5]]
    assert found("n", "in", [123456789012345678901234567890, True]) == [texts[7], texts[8]]
    assert found("it's", "eq", 1) == [texts[9]] and found("both'\"", "eq", 1) == []
    assert found("n", "contains", 9007199254740993) == [texts[10]] and found("n", "contains", 9007199254740992) == []


def test_clocks_and_dates(spark):
    rows = [("2024-01-01T10:00Z", None), ("2024-01-01T10:00", "Mars/Olympus"), ("2024-01-01T10:00", "UTC"), ("2024-01-01T10:00+02:00", None), ("2024-01-01T10:00:00", "+01:00")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, z string").select(times.strict_clock(F.col("t"), F.col("z"))).collect()]
    ten = 1704103200_000_000
    assert got == [ten, None, ten, ten - 2 * 3_600_000_000, ten - 3_600_000_000]
    assert spark.range(1).select(J.dates_in(F.lit("2024-13-45, 2024-02-29 and 2023-02-29; 2024-02-29"))).first()[0] == ["2024-02-29"]


def test_paths_to_any_depth(spark):
    deep = {"k": 1}
    for i in range(40):
        deep = {f"d{i}": [deep]} if i % 2 else {f"d{i}": deep}
    rows = [(json.dumps(deep),), ('{"a":[[{"b":1}],{"c":null}],"a.b":2}',), ("[1]",), ("null",), (None,)]
    got = {r["path"]: r["n"] for r in J.field_paths(spark.createDataFrame(rows, "t string").withColumn("r", F.try_parse_json("t")), "r").collect()}
    assert {p: got[p] for p in ("a", "a[][].b", "a[].c", "a.b")} == dict.fromkeys(("a", "a[][].b", "a[].c", "a.b"), 1)
    assert len(got) == 4 + 41 and max(p.count("d") for p in got) == 40


def test_faces_without_triangles():
    rng = np.random.default_rng(3)
    for n in range(4, 12):  # star-shaped ones, turned in space: area by the shoelace formula, volume of the cone over them
        t = np.sort(rng.uniform(0, 2 * np.pi, n)) if n > 6 else np.linspace(0, 2 * np.pi, n, endpoint=False)
        p = np.stack([np.cos(t), np.sin(t), 0 * t], 1) * rng.uniform(0.5, 2, n)[:, None]
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        if np.diff(t).max() < np.pi and t[-1] - t[0] > np.pi:
            x, y = p[:, 0], p[:, 1]
            assert np.linalg.norm(readers.face_area(p @ turn.T)) == pytest.approx(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)
    for bad in ([[0, 0, 0], [1, 1, 0], [1, 0, 0], [0, 1, 0]], [[0, 0, 0], [1, 0, 0], [2, 0, 0], [3, 0, 0]], [[0, 0, 0], [1, 0, 0], [1, 1, 1], [0, 1, 0]]):
        with pytest.raises(ValueError):
            readers.face_area(np.array(bad, float))
