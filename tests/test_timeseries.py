from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import timeseries as T

DAY = datetime(2024, 1, 1)


def facts(spark, samples):
    rows = [(1, "m", DAY + timedelta(seconds=t), v, i, True) for i, (t, v) in enumerate(samples)]
    return spark.createDataFrame(rows, "entity long, metric string, ts timestamp, value double, row long, selected boolean")


def window(a, b):
    return tuple((DAY + timedelta(seconds=s)).isoformat() + "Z" for s in (a, b))


def stats(spark, samples, a, b, threshold=0.0):
    return T.interval_statistics(facts(spark, samples), *window(a, b), threshold).collect()


def test_windows_cut_intervals(spark):
    (r,) = stats(spark, [(0, 0.0), (10, 10.0)], 2, 6, -1.0)
    assert r["weighted_average"] == pytest.approx(4) and r["seconds_above"] == pytest.approx(4)


def test_nulls_are_not_bridged(spark):
    (r,) = stats(spark, [(0, 1.0), (10, None), (20, 3.0)], 0, 20)
    assert r["weighted_average"] is None and r["n_excluded"] == 2 and r["status"] == "NO_SUPPORTED_INTERVALS"


def test_gaps_are_longer_than_three_quartiles(spark):
    x = T.intervals(facts(spark, [(0, 1.0), (10, 1.0), (20, 1.0), (30, 1.0), (200, 1.0)]), *window(0, 300)).orderBy("t").collect()
    assert [r["q25"] for r in x] == [10e6] * 4 and [bool(r["why"]) for r in x] == [False, False, False, True]


def test_one_sample(spark):
    assert stats(spark, [(0, 1.0)], 0, 10) == []
    (r,) = T.trends(facts(spark, [(0, 5.0)])).collect()
    assert (r["start_end"], r["slope"], r["monotonic"]) == (0, 0, True)


def test_equal_and_conflicting_copies(spark):
    (r,) = T.merged_samples(facts(spark, [(0, 1.0), (0, 1.0 + 1e-12)])).collect()
    assert (r["copies"], r["conflict"]) == (2, False)
    (r,) = T.merged_samples(facts(spark, [(0, 1.0), (0, 1.1)])).collect()
    assert (r["value"], r["conflict"]) == (1.0, True)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=30))
def test_warping(values):
    assert T.warped_distance(np.array(values), np.array(values)) == 0


def test_warping_against_plain_loops():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.normal(size=rng.integers(2, 20)), rng.normal(size=rng.integers(2, 20))
        x, y = (a - a.mean()) / (a.std() or 1), (b - b.mean()) / (b.std() or 1)
        w = max(abs(len(x) - len(y)), int(max(len(x), len(y)) * 0.15), 1)
        cost = {(0, 0): 0.0}
        for i in range(1, len(x) + 1):
            for j in range(max(1, i - w), min(len(y), i + w) + 1):
                cost[i, j] = abs(x[i - 1] - y[j - 1]) + min(cost.get((i - 1, j), np.inf), cost.get((i, j - 1), np.inf), cost.get((i - 1, j - 1), np.inf))
        assert T.warped_distance(a, b) == pytest.approx(cost[len(x), len(y)] / max(len(x), len(y)))


def plain_shape(v):
    v = np.array(v, float)
    if not len(v):
        return [0.0] * 12
    z = (v - v.mean()) / (v.std() or 1.0)
    lean = np.polyfit(np.arange(len(v)) / (len(v) - 1), z, 1)[0] if len(v) > 1 else 0.0
    d = np.abs(np.diff(z))
    f = np.array([*(np.quantile(z, q) for q in T.QUANTILES), lean, d.mean() if len(d) else 0, d.max() if len(d) else 0, np.log(len(v) + 1) / 10, v.std() / (abs(v.mean()) + v.std() + 1e-9)])
    return (f / (np.linalg.norm(f) or 1.0)).tolist()


def test_shapes(spark):
    rng = np.random.default_rng(4)
    curves = [[], [5.0], [2.0, 2.0, 2.0], *[rng.normal(3, 2, n).tolist() for n in (2, 3, 8, 50, 128)]]
    rows = spark.createDataFrame(list(enumerate(curves)), "i int, values array<double>")
    for r in rows.select("i", T.shape(F.col("values")).alias("shape")).collect():
        assert r["shape"] == pytest.approx(plain_shape(curves[r["i"]]), abs=1e-9)


def test_similar_curves(spark):
    rng = np.random.default_rng(5)
    query = np.sin(np.arange(16) / 3).tolist()
    curves = [(i, "m", 0, (np.array(query) * (1 + i) + rng.normal(0, 0.02 * i, 16)).tolist()) for i in range(5)] + [(9, "m", 0, rng.normal(size=16).tolist())]
    found = T.similar_curves(spark.createDataFrame(curves, "entity long, metric string, start int, values array<double>"), query, 3).collect()
    want = sorted((T.warped_distance(np.array(v), np.array(query)), i) for i, _, _, v in curves)[:3]
    assert [(r["distance"], r["entity"]) for r in found] == [(pytest.approx(x), i) for x, i in want]


def test_exact_thresholds():
    from decimal import Decimal

    for text in ("0.1", "80", "80.0000000000000000001", "79.9999999999999999999", "1e-400", "-0.3"):
        limit = T._operand(Decimal(text))
        assert Decimal(limit) <= Decimal(text) < Decimal(np.nextafter(limit, np.inf).item())
