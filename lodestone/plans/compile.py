"""From a query plan to a DataFrame. Schema checks come first; then filters, then the operation, then the limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import postings, retrieval, structured, timeseries
from .model import PlanError, QueryPlan


def checked(plan: QueryPlan, df: DataFrame) -> None:
    """Fields exist, and operators fit their types."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in plan.hard_conditions:
        if c.field not in kinds:
            raise PlanError(f"no field {c.field}")
        if c.op in ("gt", "gte", "lt", "lte", "between") and isinstance(kinds[c.field], (T.BooleanType, T.ArrayType, T.MapType)):
            raise PlanError(f"{c.op} doesn't fit {c.field}")
    for name in (plan.aggregate_field, plan.sort_field):
        if name and name not in kinds:
            raise PlanError(f"no field {name}")
    if plan.operation_of("structured") in ("sum", "min", "max", "average") and plan.aggregate_field and not structured.numeric_kind(kinds[plan.aggregate_field]):
        raise PlanError(f"{plan.aggregate_field} holds no numbers")


def run_structured(plan: QueryPlan, df: DataFrame, row_id: str | None) -> DataFrame:
    checked(plan, df)
    rows, operation = structured.filtered(df, plan.hard_conditions), plan.operation_of("structured")
    if operation == "count":
        return rows.agg(F.count(F.lit(1)).alias("n"))
    if operation in ("sum", "min", "max", "average"):
        return structured.exact_aggregate(rows, plan.aggregate_field or plan.hard_conditions[-1].field)
    if operation == "sort":
        kind = df.schema[plan.sort_field].dataType
        number = F.col(plan.sort_field).cast("double") if structured.numeric_kind(kind) else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if structured.numeric_kind(kind) else F.col(plan.sort_field).cast("string")
        tie = F.col(row_id) if row_id else F.lit(0)
        return rows.orderBy(*structured.typed_order(number, text, tie, plan.sort_descending)).limit(plan.top_k)
    return (rows.orderBy(row_id) if row_id else rows).limit(plan.top_k)


def run_plan(plan: QueryPlan, tables: dict[str, DataFrame], row_id: str | None = None) -> DataFrame:
    """The evidence of a plan with one retriever; tables holds the DataFrame of each retriever."""
    if len(plan.retrievers) != 1:
        raise PlanError("a plan with several retrievers is run by run_all")
    return run_retriever(plan, plan.retrievers[0], tables[plan.retrievers[0]], row_id)


def run_retriever(plan: QueryPlan, name: str, df: DataFrame, row_id: str | None = None) -> DataFrame:
    """The evidence of one retriever. Vectors (visual) have columns id, entity and vec; shapes (geometry) id, space and vec;
    a plan's query series is the vector that visual search compares with."""
    if name == "structured":
        return run_structured(plan, df, row_id)
    if name == "timeseries":
        return timeseries.run(plan, df)
    if name == "text":
        found = postings.bm25_of(df, row_id or "doc_id", "text", plan.query_text)
        return found.orderBy(F.desc("score"), row_id or "doc_id").limit(plan.top_k)
    if name == "geometry":
        rows = structured.filtered(df, plan.hard_conditions)
        if plan.operation_of(name) != "similar_shape":
            return rows.orderBy("id").limit(plan.top_k)
        sample = df.where(F.col("id").cast("string") == plan.query_asset_id)
        return retrieval.similar_shapes(rows, sample, "id", "vec", "space", plan.tolerance, plan.top_k)
    if plan.query_series is None and not df.columns.count("score"):
        raise PlanError("visual search needs scores or a query vector")
    return df.orderBy(F.desc("score"), "id").limit(plan.top_k)


def run_all(plan: QueryPlan, tables: dict[str, DataFrame], relations: DataFrame | None = None, keys: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The evidence of each retriever of a plan, in its order.

    A retriever that depends on others sees only rows whose entity (column keys[retriever]) some relation (source, target)
    joins to an entity of each of them: a semi-join for each dependency, however many entities there are."""
    found: dict[str, DataFrame] = {}
    for name in plan.retrievers:
        rows = tables[name]
        for source in plan.depends_on.get(name, []):
            rows = dependent(found[source], relations, rows, (keys or {})[source], (keys or {})[name])
        found[name] = run_retriever(plan, name, rows)
    return found


def dependent(source: DataFrame, relations: DataFrame, target: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """Rows of target whose entity some relation joins to an entity of source: one join instead of a plan for each entity."""
    ends = relations.join(source.select(F.col(source_key).alias("source")).distinct(), "source", "left_semi").select(F.col("target").alias(target_key)).distinct()
    return target.join(ends, target_key, "left_semi")
