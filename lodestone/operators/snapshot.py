"""Scopes of a snapshot: which assets, bindings and records a plan may look at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Condition, matches, variant_matches
from ..plans.model import QueryPlan
from .relations import PRODUCT, checkpoint_dir, closure, reachable

TEMPORAL = ("event.", "context.")


def allowed_assets(assets: DataFrame, plan: QueryPlan, kind: str | None = None) -> DataFrame:
    """Assets (asset_id, scope, format, kinds) of the plan's scope; its ids, formats and a kind narrow them where given."""
    ok = F.col("scope") == plan.corpus_scope if plan.corpus_scope is not None else F.lit(True)
    if plan.asset_ids:
        ok = ok & F.col("asset_id").isin(*plan.asset_ids)
    if plan.formats:
        ok = ok & F.col("format").isin(*plan.formats)
    if kind:
        ok = ok & F.array_contains("kinds", kind)
    return assets.where(ok)


def _selected(condition: Condition) -> list:
    return condition.value if condition.op == "in" else [condition.value]


def narrowed_bindings(bindings: DataFrame, entities: DataFrame, conditions: list[Condition]) -> DataFrame:
    """Bindings (asset_id, place, entity_id) without entities of a kind that a condition names by another value.

    entities has entity_id and primary_key, the field that is the entity's key. A condition on a key that no entity of a
    binding has leaves the binding as it is."""
    rows = bindings.join(entities.select("entity_id", "primary_key"), "entity_id", "left")
    for c in conditions:
        if c.op in ("eq", "in"):
            rows = rows.where(F.coalesce(F.col("primary_key") != c.field, F.lit(True)) | F.col("entity_id").isin(*_selected(c)))
    return rows


def bound_assets(bindings: DataFrame, entities: DataFrame, conditions: list[Condition]) -> DataFrame:
    """(asset_id, place) of the bindings whose entities' values meet all conditions, each by some value.

    entities has values, a record (VARIANT) for each entity. Conditions on event and context dates belong to dated_records."""
    rows = narrowed_bindings(bindings, entities, conditions).join(entities.select("entity_id", "values"), "entity_id", "left")
    regular = [c for c in conditions if not c.field.startswith(TEMPORAL)]
    tests = [F.bool_or(F.coalesce(variant_matches(F.col("values"), c), F.lit(False))) for c in regular]
    met = rows.groupBy("asset_id", "place").agg(reduce(lambda a, b: a & b, tests, F.lit(True)).alias("ok"))
    return met.where("ok").select("asset_id", "place")


def dated_records(records: DataFrame, references: DataFrame, anchors: list[Condition], dates: list[Condition]) -> DataFrame:
    """Records (record_id, dates map<string, timestamp>) that meet all date conditions at once, and are tied to each anchor.

    A record is tied to an anchor if references (source, target) lead from the one to the other, in either direction. Two
    records can't meet the conditions between them."""
    kind = records.schema["dates"].dataType.valueType
    ok = reduce(lambda a, b: a & b, [matches(F.try_element_at("dates", F.lit(c.field)), kind, c) for c in dates], F.lit(True))
    found = records.where(ok)
    for c in anchors:
        ids = [str(x) for x in _selected(c)]
        start = records.sparkSession.createDataFrame([(i,) for i in ids], "start string")
        back = references.select(F.col("target").alias("source"), F.col("source").alias("target"))
        tied = reachable(references, start).select("node").union(reachable(back, start).select("node")).distinct()
        found = found.join(tied, found["record_id"] == tied["node"], "left_semi")
    return found


def bound_records(bindings: DataFrame, references: DataFrame, records: DataFrame, keys: DataFrame, anchors: list[Condition], dates: list[Condition], stages: list[str] | None = None, products: DataFrame | None = None) -> DataFrame:
    """(binding, record_id): the records of each binding that meet all date conditions and are tied to each anchor inside it.

    bindings has (binding, entity_id), records (record_id, dates map<string, timestamp>, stage), keys (entity_id, primary_key).
    Only references (source, target) between two entities of one binding count: a chain that leaves the binding ties
    nothing, and two bindings can't lend each other a link. A record is tied to an anchor's value if the one leads to the
    other, in either direction; a record of the value's own kind only if it is the value. An anchor on the product key is
    met by the record's products (see product_links) instead. A record must be of one of the stages, where these are
    given. All of a binding's conditions speak of one record."""
    kind = records.schema["dates"].dataType.valueType
    ok = reduce(lambda a, b: a & b, [matches(F.try_element_at("dates", F.lit(c.field)), kind, c) for c in dates], F.lit(True))
    rows = records.where(ok if stages is None else ok & F.col("stage").isin(*stages)).select("record_id")
    checkpoint_dir(bindings.sparkSession)
    inside = bindings.select("binding", "entity_id").distinct().checkpoint()
    found = inside.join(rows, F.col("entity_id") == F.col("record_id"), "left_semi").select("binding", F.col("entity_id").alias("record_id"))
    for c in anchors:
        values = [str(x) for x in _selected(c)]
        if c.field == PRODUCT:
            met = products.where(F.col("product").isin(*values)).select(F.col("entity_id").alias("record_id")).distinct()
            found = found.join(met, "record_id", "left_semi")
            continue
        anchored = inside.where(F.col("entity_id").isin(*values)).join(found.select("binding").distinct(), "binding", "left_semi").select("binding", F.col("entity_id").alias("start")).checkpoint()
        seeds = anchored.select("binding", "start", F.col("start").alias("node"))
        held = inside.join(anchored.select("binding").distinct(), "binding", "left_semi").checkpoint()  # others hold no seed
        source, target = (held.select("binding", F.col("entity_id").alias(n)) for n in ("source", "target"))
        edges = references.select("source", "target").join(source, "source").join(target, ["binding", "target"]).where("source <> target").distinct().checkpoint()
        back = edges.select("binding", F.col("target").alias("source"), F.col("source").alias("target"))
        tied = closure(edges, seeds, ("binding",)).unionByName(closure(back, seeds, ("binding",))).distinct()
        of = lambda name: keys.select(F.col("entity_id").alias(name), F.col("primary_key").alias(f"{name}_key"))
        tied = tied.join(of("start"), "start", "left").join(of("node"), "node", "left")
        met = tied.where((F.col("start") == F.col("node")) | F.coalesce(F.col("start_key") != F.col("node_key"), F.lit(True))).select("binding", F.col("node").alias("record_id")).distinct()
        found = found.join(met, ["binding", "record_id"], "left_semi")
    return found.select("binding", "record_id")


def uncalculable_guarded(df: DataFrame, conditions: list[Column], number: Column, eligible: Column) -> DataFrame:
    """The rows that meet all conditions and the test on number, which must be calculable wherever the others hold.

    The first row that meets the others and whose cell isn't calculable fails the query. Test and guard are one expression
    that isn't split, so neither a source's statistics nor a pushed filter can take the test first and pass over the row."""
    others = reduce(lambda a, b: a & b, conditions, F.lit(True))
    failed = F.raise_error(F.lit("SOURCE_CELL_NOT_CALCULABLE")).cast("boolean")
    return df.where(others).where(F.when(F.coalesce(eligible, F.lit(False)), number).otherwise(failed))


def searched(catalog: DataFrame, status: str | None = None, business: str | None = None, modality: str | None = None, keyword: str | None = None, text: tuple[str, ...] = ("name", "description")) -> DataFrame:
    """Products of a catalog: filters that are given, and a keyword in any of the text columns, whatever its case."""
    for name, value in (("status", status), ("business", business)):
        if value:
            catalog = catalog.where(F.col(name) == value)
    if modality:
        catalog = catalog.where(F.array_contains("modalities", modality))
    return catalog.where(F.lower(F.concat_ws(" ", *text)).contains(keyword.lower())) if keyword else catalog


def named_source(sources: DataFrame, path: str, names: list[str]) -> DataFrame:
    """(name, n, id, issue): the source that each file name stands for; none and several are issues."""
    wanted = sources.sparkSession.createDataFrame([(n,) for n in names], "name string")
    held = sources.groupBy(F.lower(F.substring_index(path, "/", -1)).alias("_k")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    x = wanted.join(held, F.lower("name") == F.col("_k"), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    issue = F.when(F.col("n") == 0, "SOURCE_NOT_FOUND").when(F.col("n") > 1, "SOURCE_AMBIGUOUS")
    return x.select("name", "n", F.when(F.col("n") == 1, F.col("id")).alias("id"), issue.alias("issue"))
