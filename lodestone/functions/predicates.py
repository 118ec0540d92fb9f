"""Typed predicates of the query plan: ten operators, joined by AND.

A missing field matches nothing, not even is_null; an explicit null matches is_null alone; a value of another type is no
match and no error; booleans never equal numbers; contains is membership in a list or of a map's keys."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rationals import is_number, order_key
from .units import converted, in_source_unit

OPS = ("eq", "in", "gt", "gte", "lt", "lte", "between", "is_null", "not_null", "contains")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None
    unit: str | None = None

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op}")
        if self.op == "in" and not (isinstance(self.value, list) and 1 <= len(self.value) <= 100):
            raise ValueError("in takes 1 to 100 values")
        if self.op == "between" and not (isinstance(self.value, list) and len(self.value) == 2):
            raise ValueError("between takes two values")
        if (self.value is None) != (self.op in ("is_null", "not_null")):
            raise ValueError(f"{self.op}: value given or missing")


def _kind(value: Any) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def _kind_of(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    return "time" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string" if isinstance(kind, T.StringType) else "other"


def test(column: Column, kind: T.DataType, condition: Condition, source_unit: str | Column | None = None) -> Column:
    """condition on a typed column; null where the value is null. A filter on it compares the bare column with a literal.

    So a source's statistics can prune: operands, not columns, are cast to the column's type or converted to its unit."""
    op, value, of = condition.op, condition.value, _kind_of(kind)
    if op == "is_null":
        return column.isNull()
    if op == "not_null":
        return column.isNotNull()
    if op == "contains":
        if isinstance(kind, T.ArrayType):
            return F.array_contains(column, value) if _kind_of(kind.elementType) == _kind(value) else F.lit(False)
        return F.map_contains_key(column, value) if isinstance(kind, T.MapType) else F.lit(False)
    values = value if op in ("in", "between") else [value]
    fits = [x for x in values if _kind(x) == of or of == "time" and isinstance(x, str)]
    if condition.unit and of == "number":
        if isinstance(source_unit, str):
            fits = [in_source_unit(x, source_unit, condition.unit) for x in fits]
            fits = [x for x in fits if x is not None]
        else:
            column = converted(column.cast("double"), source_unit, condition.unit)
    elif condition.unit:
        return F.lit(False)

    def target(x: Any) -> Column:
        if of != "time":
            return F.lit(x)
        return F.lit(x).cast("date" if len(x) == 10 else "timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp").cast(kind if not isinstance(kind, T.DateType) or len(x) == 10 else "timestamp")

    operands = [target(x) for x in fits]
    if op == "in":
        return column.isin(*operands) if operands else F.lit(False)
    if len(operands) < len(values):
        return F.lit(False)
    return {"eq": column.__eq__, "gt": column.__gt__, "gte": column.__ge__, "lt": column.__lt__, "lte": column.__le__, "between": column.between}[op](*operands)


def matches(column: Column, kind: T.DataType, condition: Condition, present: Column | None = None, source_unit: str | Column | None = None) -> Column:
    """condition on a typed column as a boolean that is never null; present tells missing fields from nulls."""
    found = F.coalesce(test(column, kind, condition, source_unit), F.lit(False))
    return found if present is None else present & found


def field_of(record: Column, path: str) -> Column:
    """The field of a VARIANT record under a dotted path, as VARIANT; null if there is none.

    A key that holds the dots itself comes first; a step of digits is a place in a list, or else a key."""
    steps = path.split(".")
    found = [_at(record, [_key(x) for x in steps])]
    if any(x.isdigit() for x in steps):
        found.insert(0, _at(record, [f"[{x}]" if x.isdigit() else _key(x) for x in steps]))
    return F.coalesce(_at(record, [_key(path)]), *found)


def _key(name: str) -> str | None:
    """A step of a path to a key; a name with both kinds of quotes has none."""
    quote = '"' if "'" in name else "'"
    return None if quote in name else f"[{quote}{name}{quote}]"


def _at(record: Column, steps: list[str | None]) -> Column:
    return F.lit(None).cast("variant") if None in steps else F.try_variant_get(record, "$" + "".join(steps), "variant")


def _number_compares(raw: Column, x: int | float, how: str) -> Column:
    """A VARIANT number against an operand, exactly: as longs where both are, else by their digits."""
    way = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[how]
    text = F.try_variant_get(raw, "$", "string")
    by_digits = F.when(is_number(text), way(order_key(text), order_key(F.lit(repr(x)))))
    if isinstance(x, int) and abs(x) < 2**63:
        return F.when(F.schema_of_variant(raw) == "BIGINT", way(F.try_variant_get(raw, "$", "bigint"), F.lit(x).cast("long"))).otherwise(by_digits)
    return by_digits


def variant_matches(record: Column, condition: Condition) -> Column:
    """condition on a field of a VARIANT record, whose rows may hold it, hold null, or not hold it; types vary by row."""
    raw = field_of(record, condition.field)
    missing, null = raw.isNull(), F.is_variant_null(raw)
    op, value = condition.op, condition.value
    if op == "is_null":
        return ~missing & F.coalesce(null, F.lit(False))
    if op == "not_null":
        return ~missing & ~F.coalesce(null, F.lit(False))
    type_name = F.schema_of_variant(raw)
    of_kind = {"boolean": type_name == "BOOLEAN", "number": type_name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "string": type_name == "STRING"}
    as_type = {"boolean": "boolean", "number": "double", "string": "string"}

    def compare(x: Any, how: str) -> Column:
        k = _kind(x)
        if k == "number":
            return of_kind[k] & F.coalesce(_number_compares(raw, x, how), F.lit(False))
        got = F.try_variant_get(raw, "$", as_type[k])
        test = {"eq": got == x, "gt": got > x, "gte": got >= x, "lt": got < x, "lte": got <= x}[how]
        return of_kind[k] & F.coalesce(test, F.lit(False))

    if op == "contains":
        items = F.try_variant_get(raw, "$", "array<variant>")
        k = _kind(value)
        equal = (lambda v: _number_compares(v, value, "eq")) if k == "number" else (lambda v: F.try_variant_get(v, "$", as_type[k]) == value)
        same = F.exists(items, lambda v: F.coalesce(equal(v), F.lit(False)) & {"boolean": F.schema_of_variant(v) == "BOOLEAN", "number": F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "string": F.schema_of_variant(v) == "STRING"}[k])
        return F.coalesce(same, F.lit(False))
    if op == "in":
        return reduce(lambda a, b: a | b, [compare(x, "eq") for x in value])
    if op == "between":
        return compare(value[0], "gte") & compare(value[1], "lte")
    return compare(value, op)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
