"""Functions on records: nested paths, leaves, cells that hold JSON, boxes, confidences."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(record: Column, path: str) -> Column:
    """The values (list of VARIANT) of a record under a path such as a.b[].c; each [] goes over a list.

    A step that isn't there, or isn't a list where it should be, gives no values. A null is a value."""
    under = lambda at: lambda v: F.try_variant_get(v, at, "variant")
    found = F.array(record)
    for step in path.split("."):
        found = F.filter(F.transform(found, under(f"$['{step.rstrip('[]')}']")), lambda v: v.isNotNull())
        for _ in range(step.count("[]")):
            found = F.flatten(F.transform(found, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))))
    return found


def paths_of(record) -> set[str]:
    """Every field path of a decoded JSON record, however deep; lists add [] to a path."""
    found: set[str] = set()
    waiting = [("", record)]
    while waiting:
        path, v = waiting.pop()
        if isinstance(v, dict):
            inner = [(f"{path}.{k}" if path else k, x) for k, x in v.items()]
            found.update(p for p, _ in inner)
            waiting += inner
        elif isinstance(v, list):
            waiting += [(f"{path}[]", x) for x in v if isinstance(x, (dict, list))]
    return found


def field_paths(records: DataFrame, record: str) -> DataFrame:
    """(path, n): every field that some record (VARIANT) holds, and how many records hold it.

    Each record is walked once, to any depth; tasks add up what they have seen before it is shuffled."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for text in b.column(0).to_pylist():
                if text is not None:
                    n.update(paths_of(json.loads(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["path", "n"])

    return records.select(F.to_json(record).alias("t")).mapInArrow(of, "path string, n long").groupBy("path").agg(F.sum("n").alias("n"))


def decoded_cells(columns: dict[str, Column]) -> dict[str, Column]:
    """Cells of columns named *_json as VARIANT under the name without the ending; text that is no JSON becomes null."""
    return {name.removesuffix("_json"): F.try_parse_json(c) if name.endswith("_json") else c for name, c in columns.items()}


def string_leaves(text: Column) -> Column:
    """All strings that a JSON text holds as values, in order; keys, numbers and others aren't among them.

    They are cut out of the text with their quotes; what a colon follows is a key."""
    quoted = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"\s*(:?)'), F.lit(0))
    values = F.filter(quoted, lambda q: ~q.rlike(r":$"))
    return F.transform(values, lambda q: F.try_variant_get(F.try_parse_json(F.regexp_replace(q, r"\s+$", "")), "$", "string"))


def normalised(text: Column) -> Column:
    """Text with runs of white space as one space, trimmed; an empty one is null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def compact_decimal(value: Column) -> Column:
    """A decimal as plain text without zeros at its end."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def box_around(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """(x0, y0, x1, y1) around the boxes of a group, as an aggregate."""
    return F.struct(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"))


def box_overlap(a: Column, b: Column) -> Column:
    """The area that two boxes share; 0 if they only touch."""
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    return side("x0", "x1") * side("y0", "y1")


def mean_probability(log_probability: Column) -> Column:
    """The mean probability of a group's tokens, as an aggregate; null without tokens."""
    return F.avg(F.exp(log_probability))


def without_output_instructions(text: Column, phrases: list[str]) -> Column:
    """A question without what it says about the form of the answer."""
    out = text
    for p in sorted(phrases, key=len, reverse=True):
        out = F.regexp_replace(out, f"(?i){p}", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def dates_in(text: Column) -> Column:
    """Distinct ISO dates that a text names, in order; what no calendar has isn't one."""
    named = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{4}-\d\d-\d\d)(?!\d)"), F.lit(1)))
    return F.array_sort(F.filter(named, lambda x: x.try_cast("date").isNotNull()))


def declared_zone(text: Column) -> Column:
    """The time zone that a worksheet declares, as timezone: Area/City, UTC or an offset; null if none."""
    return F.nullif(F.regexp_extract(text, r"(?i)\b(?:time\s?zone|tz|时区)\s*[:=：]\s*([A-Za-z]+/[A-Za-z_]+|UTC|Z|[+-]\d\d:\d\d)", 1), F.lit(""))


def date_role(field: Column) -> Column:
    """event for dates of what happened, context for those of its surroundings, by the end of a field's name."""
    return F.when(field.rlike(r"_(at|time|date)$") & ~field.rlike(r"(^|_)(valid|contract|effective|expire[sd]?)(_|$)"), "event").when(field.rlike(r"_(at|time|date|from|to|until)$"), "context")
