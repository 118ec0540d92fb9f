"""Measurement units: conversion inside a dimension, and suffixes of metric names."""

from __future__ import annotations

import re
from decimal import Decimal
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of the plan language, with their size in the dimension's base unit.
FACTORS = {
    "length": {"mm": "0.001", "cm": "0.01", "m": "1", "毫米": "0.001", "厘米": "0.01", "米": "1"},
    "time": {"s": "1", "min": "60", "h": "3600"},
    "area": {"mm2": "0.000001", "cm2": "0.0001", "m2": "1"},
    "volume": {"mm3": "0.000000001", "cm3": "0.000001", "m3": "1"},
}
# Other spellings.
SPELLINGS = {"°C": "C", "℃": "C", "摄氏度": "C", "开尔文": "K", "mm²": "mm2", "cm²": "cm2", "m²": "m2", "mm³": "mm3", "cm³": "cm3", "m³": "m3"}
KELVIN = Decimal("273.15")
# Units that the ends of metric names stand for; the first that fits holds.
SUFFIXES = (
    ("_kwh", "kWh"), ("_wh", "Wh"), ("_percent", "%"), ("_pct", "%"), ("_celsius", "°C"), ("_degc", "°C"), ("_mm", "mm"), ("_cm", "cm"), ("_km", "km"),
    ("_min", "min"), ("_ms", "ms"), ("_hour", "h"), ("_hours", "h"), ("_sec", "s"), ("_seconds", "s"), ("_c", "°C"), ("_w", "W"),
)
# Declared units of records, case-sensitive, with their dimension's base unit, scale and offset in it.
RECORD_UNITS = {
    "W": {"mW": "0.001", "W": "1", "kW": "1000", "MW": "1000000"},
    "m": {"µm": "0.000001", "um": "0.000001", "mm": "0.001", "cm": "0.01", "m": "1", "km": "1000"},
    "m²": {"mm²": "0.000001", "mm2": "0.000001", "cm²": "0.0001", "cm2": "0.0001", "m²": "1", "m2": "1"},
    "L": {"mL": "0.001", "L": "1", "mm³": "0.000001", "mm3": "0.000001", "cm³": "0.001", "cm3": "0.001", "m³": "1000", "m3": "1000"},
    "kg": {"mg": "0.000001", "g": "0.001", "kg": "1", "t": "1000"},
    "s": {"ms": "0.001", "s": "1", "min": "60", "h": "3600"},
    "K": {"K": "1", "°C": "1", "℃": "1"},
    "A": {"mA": "0.001", "A": "1"},
    "m/s": {"mm/s": "0.001", "m/s": "1"},
    "rpm": {"rpm": "1", "r/min": "1"},
}
RECORD_OFFSETS = {"°C": "273.15", "℃": "273.15"}

UNKNOWN, INCOMPATIBLE = "UNIT_UNKNOWN", "UNIT_INCOMPATIBLE"


def linear(source: str, target: str) -> tuple[Decimal, Decimal] | None:
    """(factor, offset) with target = source * factor + offset; None if the units measure different things."""
    source, target = SPELLINGS.get(source, source), SPELLINGS.get(target, target)
    if source == target:
        return Decimal(1), Decimal(0)
    if {source, target} == {"C", "K"}:
        return Decimal(1), KELVIN if target == "K" else -KELVIN
    for sizes in FACTORS.values():
        if source in sizes and target in sizes:
            return Decimal(sizes[source]) / Decimal(sizes[target]), Decimal(0)
    return None


def rational(source: str, target: str) -> tuple[Fraction, Fraction] | None:
    """linear() without rounding: seconds are a 3600th of an hour."""
    source, target = SPELLINGS.get(source, source), SPELLINGS.get(target, target)
    for sizes in FACTORS.values():
        if source in sizes and target in sizes:
            return Fraction(sizes[source]) / Fraction(sizes[target]), Fraction(0)
    found = linear(source, target)
    return found and (Fraction(found[0]), Fraction(found[1]))


def known_units() -> list[str]:
    return [*SPELLINGS, "C", "K", *[u for sizes in FACTORS.values() for u in sizes]]


def _by_unit(unit: Column, target: str, of) -> Column:
    """of(factor, offset) for the row's unit; null for units that don't convert."""
    chosen = F.when(unit == target, of(Decimal(1), Decimal(0)))
    for u in known_units():
        if u != target and (l := linear(u, target)):
            chosen = chosen.when(unit == u, of(*l))
    return chosen


def converted(value: Column, source: str | Column | None, target: str | None) -> Column:
    """value in the target unit; null where the row's unit is unknown or measures something else."""
    if target is None:
        return value
    if source is None:
        return F.lit(None).cast("double")
    if isinstance(source, str):
        l = linear(source, target)
        return value * float(l[0]) + float(l[1]) if l else F.lit(None).cast("double")
    return _by_unit(source, target, lambda f, o: value * float(f) + float(o))


def conversion_status(source: Column, target: str) -> Column:
    ok = _by_unit(source, target, lambda f, o: F.lit(True))
    return F.when(source.isNull() | (source == ""), F.lit(UNKNOWN)).when(ok, F.lit("OK")).otherwise(F.lit(INCOMPATIBLE))


def exact(value: Column, source: Column, target: str, scale: int = 12) -> Column:
    """The same in decimals, for equality across units without float drift."""
    return _by_unit(source, target, lambda f, o: value.cast(f"decimal(38,{scale})") * F.lit(str(f)).cast("decimal(18,9)") + F.lit(str(o)).cast("decimal(18,9)"))


def in_source_unit(value: float, source: str, target: str) -> float | None:
    """A number of the target unit as one of the source unit, so that a column of source units can be compared as it is."""
    l = linear(target, source)
    if l is None:
        return None
    exact_value = Decimal(str(value)) * l[0] + l[1]
    return int(exact_value) if exact_value == exact_value.to_integral_value() and isinstance(value, int) else float(exact_value)


def unit_of_metric(name: Column) -> Column:
    """The unit that a metric's name ends with, by the first suffix of the list that fits."""
    chosen = F.when(F.lit(False), F.lit(""))
    for suffix, unit in SUFFIXES:
        chosen = chosen.when(F.lower(name).endswith(suffix), F.lit(unit))
    return chosen


def record_base(unit: Column) -> Column:
    """The base unit of a declared unit; null if it isn't registered."""
    chosen = F.when(F.lit(False), F.lit(""))
    for base, scales in RECORD_UNITS.items():
        chosen = chosen.when(unit.isin(*scales), F.lit(base))
    return chosen


def record_fraction(text: str | None, unit: str | None) -> Fraction | None:
    """A number's text in its unit's base, exactly; null if it is no number in the budget, or the unit isn't registered."""
    scale = next((scales[unit] for scales in RECORD_UNITS.values() if unit in scales), None)
    if text is None or scale is None or not BUDGET.fullmatch(text.strip()):
        return None
    return Fraction(text.strip()) * Fraction(scale) + Fraction(RECORD_OFFSETS.get(unit, "0"))


#: Up to 4096 digits and an exponent of four.
BUDGET = re.compile(r"[+-]?(?=\.?\d)\d{0,4096}\.?\d{0,4096}([eE][+-]?0*\d{1,4})?")


def record_values_equal(values: list[tuple[Column, Column]]) -> Column:
    """Whether (value, unit) of two to four sources are the same, each compared with the first; null if units don't compare.

    Numbers are compared as rationals in Arrow batches: 4e-7 kg isn't 0 kg, and a value that isn't a number compares with nothing."""
    (first, unit), *rest = values
    fit = record_base(unit).isNotNull()
    for _, other in rest:
        fit = fit & (record_base(other) == record_base(unit))
    texts, units = F.array(*[v.cast("string") for v, _ in values]), F.array(*[u for _, u in values])
    return F.when(F.coalesce(fit, F.lit(False)), _same()(texts, units))


@lru_cache(maxsize=1)
def _same():
    @F.arrow_udf("boolean")
    def same(texts: pa.Array, units: pa.Array) -> pa.Array:
        out = []
        for ts, us in zip(texts.to_pylist(), units.to_pylist(), strict=True):
            xs = [record_fraction(t, u) for t, u in zip(ts or [], us or [], strict=True)]
            out.append(None if not xs or None in xs else all(x == xs[0] for x in xs))
        return pa.array(out, pa.bool_())

    return same
