import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import units
from lodestone.functions.predicates import Condition, matches, variant_matches
from lodestone.operators.structured import exact_aggregate, filtered
from lodestone.plans.model import PlanError, QueryPlan, TimeRange, operand


def found(spark, texts, condition):
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "i int, t string")
    return [r["i"] for r in rows.where(variant_matches(F.parse_json("t"), condition)).orderBy("i").collect()]


def test_missing_null_and_empty_differ(spark):
    rows = ['{"a":1}', '{"a":null}', "{}", '{"a":""}']
    assert found(spark, rows, Condition("a", "is_null")) == [2]
    assert found(spark, rows, Condition("a", "not_null")) == [1, 4]


def test_booleans_are_no_numbers(spark):
    rows = ['{"a":true}', '{"a":1}', '{"a":"1"}']
    assert found(spark, rows, Condition("a", "eq", True)) == [1]
    assert found(spark, rows, Condition("a", "eq", 1)) == [2]
    assert found(spark, rows, Condition("a", "eq", "1")) == [3]


def test_contains_is_membership(spark):
    assert found(spark, ['{"a":["ab"]}', '{"a":"ab"}'], Condition("a", "contains", "ab")) == [1]


@pytest.mark.parametrize("bad", [("in", []), ("between", [1]), ("eq", None), ("is_null", 1), ("like", "x")])
def test_bad_conditions(bad):
    with pytest.raises(ValueError):
        Condition("a", *bad)


@settings(max_examples=50, deadline=None)
@given(st.sampled_from([("mm", "m"), ("cm", "mm"), ("min", "h"), ("C", "K"), ("m2", "cm2")]))
def test_units_round_trip(pair):
    f, o = units.linear(*pair)
    g, p = units.linear(*reversed(pair))
    assert abs(float(f * g) - 1) < 1e-12 and abs(float(o * g + p)) < 1e-9


def test_units_of_other_dimensions():
    assert units.linear("mm", "s") is None and units.linear("℃", "K") == (1, units.KELVIN)


def test_plans():
    ok = dict(task_intent="x", retrievers=["timeseries"], operation="average", metric="m", time_range=TimeRange("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"))
    QueryPlan(**ok)
    for change in (dict(metric=None), dict(time_range=None), dict(operation="sort"), dict(operation="duration_above"), dict(top_k=51), dict(retrievers=["text"]), dict(query_asset_id="a"), dict(depends_on={"timeseries": ["text"]})):
        with pytest.raises(PlanError):
            QueryPlan(**{**ok, **change})
    for ends in (("2024-01-01T00:00:00", "2024-01-02T00:00:00"), ("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z")):
        with pytest.raises(PlanError):
            TimeRange(*ends)


@pytest.mark.parametrize(
    ("condition", "unit", "pushed"),
    [
        (("x", "eq", 5), None, "EqualTo(x,5.0)"),
        (("x", "in", [1, 2]), None, "In(x, [1.0,2.0])"),
        (("x", "gt", 5), None, "GreaterThan(x,5.0)"),
        (("x", "between", [1, 2]), None, "GreaterThanOrEqual(x,1.0), LessThanOrEqual(x,2.0)"),
        (("d", "gte", "1995-03-01"), None, "GreaterThanOrEqual(d,1995-03-01"),
        (("n", "lt", "1995-03-01T10:00:00"), None, "LessThan(n,1995-03-01T10:00"),
        (("s", "eq", "a"), None, "EqualTo(s,a)"),
        (("x", "eq", 1700, "cm"), "m", "EqualTo(x,17.0)"),
        (("x", "not_null"), None, "IsNotNull(x)"),
    ],
)
def test_predicates_reach_the_reader(spark, tmp_path, condition, unit, pushed):
    path = str(tmp_path / "t")
    spark.sql("SELECT 1.0D AS x, timestamp'1995-03-02' AS d, timestamp_ntz'1995-03-02' AS n, 'a' AS s").write.parquet(path)
    plan = filtered(spark.read.parquet(path), [Condition(*condition)], {"x": unit} if unit else None)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    line = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert pushed in line, line


def test_matches_is_never_null(spark):
    rows = spark.createDataFrame([(1.0,), (None,)], "x double")
    kind = rows.schema["x"].dataType
    assert [r[0] for r in rows.select(matches(F.col("x"), kind, Condition("x", "gt", 0))).collect()] == [True, False]
    assert rows.where(~matches(F.col("x"), kind, Condition("x", "gt", 0))).count() == 1


@pytest.mark.parametrize("text", ["+1", ".5", "1.", "01", "1e", "NaN", "0x1", " 1", "1" * 5000, "1e5000"])
def test_operands_follow_json(text):
    with pytest.raises(PlanError):
        operand(text)


def test_good_operands():
    assert [str(operand(x)) for x in ("-0.10", "1e3", 2.5, 7)] == ["-0.10", "1E+3", "2.5", "7"]


def test_paths_of_records(spark):
    rows = ['{"a.b":1,"a":{"b":2}}', '{"a":{"b":1}}', '{"a":[5,{"b":1}]}', '{"a":{"1":{"b":1}}}', '{"a":1}']
    assert found(spark, rows, Condition("a.b", "eq", 1)) == [1, 2]
    assert found(spark, rows, Condition("a.1.b", "eq", 1)) == [3, 4]


def test_numbers_beyond_the_decimals(spark):
    rows = spark.createDataFrame([(1.5,), (2e30,), (None,), (float("nan"),)], "x double")
    r = exact_aggregate(rows, "x").first()
    assert (r["matched"], r["numbers"], r["excluded"], r["sum_value"], r["status"]) == (4, 2, 2, None, "EXACT_RANGE_EXCEEDED")
    r = exact_aggregate(rows.where("x < 2"), "x").first()
    assert (r["sum_value"], r["average_value"], r["status"]) == (1.5, 1.5, "OK")
