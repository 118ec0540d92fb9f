"""Plans against a catalog, merged channels, claims that repeat, sizes in units, times that texts name."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import times
from lodestone.functions.predicates import Condition
from lodestone.operators import retrieval as R
from lodestone.plans import analyse as A
from lodestone.plans.model import PlanError, QueryPlan, TimeRange


@pytest.fixture(scope="module")
def catalog(spark):
    t = spark.createDataFrame([], "id long, size double, name string, ok boolean, day date, at timestamp, tags array<string>, width double")
    fields = A.fields_of(t, "parts", "corpus", {"size": "mm"}, {"width": ("width_unit", ["mm", "cm"])})
    series = spark.createDataFrame([("a1", "s1", "power", "kW"), ("a1", "s1", "load", None)], "asset_id string, series_id string, metric string, unit string")
    return A.Catalog(fields, series, spark.createDataFrame([("a1", "corpus", "csv")], "asset_id string, scope string, format string"))


def plan(*conditions, **more):
    return QueryPlan(**({"task_intent": "x", "retrievers": ["structured"], "operation": "search", "table_id": "parts", "hard_conditions": list(conditions)} | more))


RANGE = TimeRange("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")
CASES = [
    (plan(Condition("size", "gt", 1, "mm"), Condition("name", "in", ["a"]), Condition("tags", "contains", "x"), Condition("day", "eq", "2024-01-01"), Condition("at", "lt", "2024-01-01T00:00:00Z"), Condition("width", "eq", 1, "m")), []),
    (plan(Condition("name", "gt", "a")), ["name doesn't know gt"]),
    (plan(Condition("size", "eq", 1, "cm")), ["size is measured in mm, not in cm"]),
    (plan(Condition("id", "eq", 1, "cm")), ["id is measured in no known unit, not in cm"]),
    (plan(Condition("width", "eq", 1)), ["width has a unit in each row: the condition needs one"]),
    (plan(Condition("width", "eq", 1, "s")), ["s fits no unit of width"]),
    (plan(Condition("width", "is_null")), []),
    (plan(Condition("size", "eq", True)), ["size needs numbers"]),
    (plan(Condition("ok", "eq", 1)), ["ok needs true or false"]),
    (plan(Condition("name", "eq", 1)), ["name needs text"]),
    (plan(Condition("day", "eq", "2024-01-01T00:00:00Z")), ["day is a date, without a time"]),
    (plan(Condition("at", "eq", "2024-01-01T00:00:00")), ["at needs times with a zone"]),
    (plan(Condition("at", "eq", "soon")), ["at needs ISO times"]),
    (plan(Condition("size", "between", [2, 1])), ["the range of size ends before it starts"]),
    (plan(Condition("day", "between", ["2024-01-02", "2024-01-01"])), ["the range of day ends before it starts"]),
    (plan(Condition("gone", "eq", 1), operation="sort", sort_field="gone"), ["the table has no field gone"]),
    (plan(operation="sum", aggregate_field="name"), ["name has no sum"]),
    (plan(operation="sum", aggregate_field="size", unit="m"), ["m is no unit of size"]),
    (plan(operation="sum", aggregate_field="width", unit="cm"), []),
    (plan(table_id="other"), ["records need a table of the snapshot"]),
    (plan(corpus_scope="mine", asset_ids=["a1", "a2"], formats=["csv", "pdf"]), ["file a2 isn't in the snapshot", "format pdf isn't in the snapshot", "the table is of another scope"]),
    (plan(retrievers=["timeseries"], table_id=None, operation="average", metric="power", unit="kW", time_range=RANGE), ["an exact calculation needs its series"]),
    (plan(retrievers=["timeseries"], table_id=None, operation="average", metric="load", unit="kW", target_entity="s1", time_range=RANGE), ["the series isn't measured in kW"]),
    (plan(retrievers=["timeseries"], table_id=None, operation="average", metric="power", target_entity="s2", time_range=RANGE), ["the snapshot has no such series"]),
]


@pytest.mark.parametrize(("p", "want"), CASES, ids=[str(i) for i in range(len(CASES))])
def test_plans_against_the_catalog(catalog, p, want):
    assert A.problems(p, catalog) == want
    if want:
        with pytest.raises(PlanError):
            A.analysed(p, catalog)
    else:
        assert A.analysed(p, catalog) is p


def test_merged_channels(spark):
    rng = random.Random(2)
    lists = {name: [(k, i, rng.choice([0.1, 0.5, 0.9]), f"{name}{k}") for i, k in enumerate(rng.sample(range(12), 7), 1)] for name in ("b", "a", "c")}
    seen = {}
    for name, rows in lists.items():  # one after the other, as a person would
        for k, rank, score, preview in rows:
            if k not in seen:
                seen[k] = [0.0, score, preview, set(), len(seen)]
            s = seen[k]
            s[0] += 1 / (60 + rank)
            s[3].add(name)
            if score > s[1]:
                s[1:3] = score, preview
    want = sorted(seen.items(), key=lambda kv: (-round(kv[1][0], 12), -kv[1][1], kv[1][4]))[:9]
    channels = {n: spark.createDataFrame(rows, "k int, rank int, score double, preview string") for n, rows in lists.items()}
    got = R.merged(channels, "k", 9, ("preview",)).orderBy("place").collect()
    assert [(r["k"], r["score"], r["preview"], r["source"]) for r in got] == [(k, s[1], s[2], "search_dual_match" if len(s[3]) > 1 else min(s[3])) for k, s in want]


def test_claims(spark):
    claim = lambda fields, key="k", range=None: {"type": "t", "key": key, "range": range, "fields": fields}  # noqa: E731, A002
    words = lambda t: t.split()
    cases = [
        ([claim({"a": "1"})], [claim({"a": "1", "b": "2"})], "x", "y", 1.0),
        ([claim({"a": "1", "b": "2"})], [claim({"a": "1"})], "x y", "x y", 0.79),
        ([claim({"a": "1"})], [claim({"a": "2"})], "x y", "x z w", 0.25),
        ([claim({"a": None})], [claim({"a": None})], "x", "y", 1.0),
        ([claim({"a": None})], [claim({"a": "1"})], "x", "y", 0.0),
        ([claim({"a": "1"}), claim({"a": "1"}, "other")], [claim({"a": "1"})], "x", "x", 0.79),
        ([claim({"a": "1"}, range="r")], [claim({"a": "1"})], "x", "x", 0.79),
        ([], [claim({"a": "1"})], "x y", "x y", 1.0),
        ([], [], "", "", 0.0),
    ]
    shape = "array<struct<type:string,key:string,range:string,fields:map<string,string>>>"
    df = spark.createDataFrame([(i, a, b, words(x), words(y)) for i, (a, b, x, y, _) in enumerate(cases)], f"i int, a {shape}, b {shape}, x array<string>, y array<string>")
    assert [r[0] for r in df.orderBy("i").select(R.redundancy(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).collect()] == [c[4] for c in cases]


def test_sizes_in_units(spark):
    rows = [([10.0, 20.0], "mm", [2.0, 1.0], "cm", True), ([1.0], "m", [100.9], "cm", True), ([1.0], "m", [102.0], "cm", False), ([1.0], "m", [1.0, 1.0], "m", False), ([1.0], "m", [1.0], "s", None), ([1.0], None, [1.0], "m", None), (None, "m", [1.0], "m", None)]
    df = spark.createDataFrame(rows, "a array<double>, ua string, b array<double>, ub string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", R.same_dimensions_in(F.col("a"), F.col("ua"), F.col("b"), F.col("ub"), 0.01).alias("got")).collect())


def test_pairs_of_characters(spark):
    texts = ["AB 温，度x传", "温", "", None, "温温温"]
    got = [r[0] and sorted(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.question_terms(F.col("t"))).collect()]
    assert got == [sorted(["ab", "x", "温度", "度传"]), [], [], None, ["温温"]]


LITERALS = [
    ("2024-01-02 03:04 and 2024-01-02T03:04:05.5z", {"datetime 2024-01-02T03:04", "datetime 2024-01-02T03:04:05.5+00:00", "date 2024-01-02", "clock 03:04", "clock 03:04:05.5"}),
    ("2024年2月29日, 2023年2月29日", {"date 2024-02-29"}),
    ("9:05, 24:00, 12:60, 23:59:59", {"clock 09:05", "clock 23:59:59", "clock 23:59"}),
    ("x1:30 10:305 1:2 2024-02-30T01:00", set()),
]


def test_times_in_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LITERALS)], "i int, t string")
    for r, (_, want) in zip(df.orderBy("i").select(times.literals(F.col("t"))).collect(), LITERALS, strict=True):
        assert r[0] == sorted(want)


def test_older_choice_of_a_time_column(spark):
    rows = [(1_700_000_000 + i, "2024-01-01" if i else "?", "2024-01-01", i, True) for i in range(10)]
    df = spark.createDataFrame(rows, "epoch_time long, note string, other string, plain long, flag boolean")
    assert times.older_time_column(df) == ("epoch_time", 1.0)
    assert times.older_time_column(df.select("note", "other", "plain")) == ("other", 0.8)
    assert times.older_time_column(df.select("plain", "flag")) == (None, 0.0) and times.older_time_column(df.limit(0)) == (None, 0.0)
