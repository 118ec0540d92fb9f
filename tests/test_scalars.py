"""Functions on names and records that SQL can't check."""

import uuid

from pyspark.sql import functions as F

from lodestone.functions import records as J
from lodestone.functions import text as X


def test_name_based_identifiers(spark):
    names = ["", "a", "https://example.org/温", "x" * 300]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.uuid_of(str(uuid.NAMESPACE_URL), F.col("n")).alias("u")).collect()
    assert {r["n"]: r["u"] for r in rows} == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_leaves_of_escaped_text(spark):
    text = '{"a\\"b": "c\\\\", "d": ["e: \\"f\\"", 1, null, {"g": ""}]}'
    assert spark.range(1).select(J.string_leaves(F.lit(text))).first()[0] == ["c\\", 'e: "f"', ""]


def test_confidence_without_tokens(spark):
    rows = spark.createDataFrame([("a", None), ("b", 0.0), ("b", float("-inf"))], "k string, lp double")
    assert [r[1] for r in rows.groupBy("k").agg(J.mean_probability(F.col("lp"))).orderBy("k").collect()] == [None, 0.5]


def test_nested_paths_of_other_shapes(spark):
    rows = spark.createDataFrame([('{"a":{"b":[[{"c":1}],[{"c":2},{}]]}}',), ('{"a":[1]}',), ("[1]",)], "t string")
    n = rows.select(F.size(J.nested(F.parse_json("t"), "a.b[][].c"))).collect()
    assert [r[0] for r in n] == [2, 0, 0]
