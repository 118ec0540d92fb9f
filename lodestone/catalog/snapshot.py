"""Queries over scopes, bindings, dated records, product catalogs and plans with several retrievers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.predicates import Condition
from ..operators import retrieval as R
from ..operators import snapshot as S
from ..operators import structured
from ..plans.compile import run_all
from ..plans.model import QueryPlan
from .registry import load, query


def _plan(**more) -> QueryPlan:
    return QueryPlan(task_intent="x", retrievers=["text"], query_text="x", **more)


@query("SELECT doc_id::VARCHAR AS asset_id FROM documents WHERE source = (SELECT min(source) FROM documents) AND lang IN ('en', 'fr') AND n_chars > 200")
def scope_filter(spark, d):
    docs = load(spark, d, "documents")
    assets = docs.select(F.col("doc_id").cast("string").alias("asset_id"), F.col("source").alias("scope"), F.col("lang").alias("format"), F.when(F.col("n_chars") > 200, F.array(F.lit("text"), F.lit("long"))).otherwise(F.array(F.lit("text"))).alias("kinds"))
    plan = _plan(corpus_scope=docs.agg(F.min("source")).first()[0], formats=["en", "fr"])
    return S.allowed_assets(assets, plan, "long").select("asset_id")


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS asset_id, l_partkey FROM lineitem) SELECT asset_id, l_linenumber AS place FROM
    (SELECT l_orderkey AS asset_id, l_linenumber, bool_or(p_size > 20) AS big, bool_or(p_brand = 'Brand#7') AS brand FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE big AND brand""")
def binding_filter(spark, d):
    """Order lines bound to parts: one of a size over 20, and one of the brand, which may be another part of the line."""
    bindings = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("place"), F.col("l_partkey").cast("string").alias("entity_id"))
    p = load(spark, d, "part")
    entities = p.select(F.col("p_partkey").cast("string").alias("entity_id"), F.lit("part_id").alias("primary_key"), F.parse_json(F.to_json(F.struct("p_size", "p_brand"))).alias("values"))
    return S.bound_assets(bindings, entities, [Condition("p_size", "gt", 20), Condition("p_brand", "eq", "Brand#7")])


@query("""SELECT 'o' || o_orderkey AS record_id FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8) AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate + to_days((o_orderkey % 200)::INT) < TIMESTAMP '1997-01-01'""")
def temporal_record_filter(spark, d):
    """Orders of some customers whose two dates both lie in a range; one order can't lend its date to another."""
    o = load(spark, d, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    later = F.timestamp_micros(F.unix_micros(at) + (F.col("o_orderkey") % 200) * F.lit(86_400_000_000))
    key = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    records = o.select(key.alias("record_id"), F.create_map(F.lit("event.ordered"), at, F.lit("event.due"), later).alias("dates"))
    references = o.select(key.alias("source"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target"))
    dates = [Condition("event.ordered", "gte", "1995-01-01"), Condition("event.due", "lt", "1997-01-01")]
    return S.dated_records(records, references, [Condition("customer_id", "in", ["c1", "c2", "c3", "c5", "c8"])], dates).select("record_id")


@query("""SELECT DISTINCT 'o' || o_orderkey AS binding, 'o' || o_orderkey AS record_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 AND l_partkey % 10 = 1 AND l_partkey < 1000 AND o_orderdate >= DATE '1994-01-01' AND o_orderstatus IN ('F', 'O')""")
def binding_records(spark, d):
    """An order and its first two lines are a binding; orders of a period that lead to one of some parts inside it.

    Lines beyond the second hold references too, but aren't in the binding, and orders of one customer are tied through
    their customer, who is in none."""
    k = lambda p, *cs: F.concat_ws("-", F.concat(F.lit(p), F.col(cs[0]).cast("string")), *[F.col(c).cast("string") for c in cs[1:]])
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    order, line, part = k("o", "l_orderkey"), k("l", "l_orderkey", "l_linenumber"), k("p", "l_partkey")
    near = li.where("l_linenumber <= 2")
    bindings = o.select(k("o", "o_orderkey").alias("binding"), k("o", "o_orderkey").alias("entity_id")).unionByName(near.select(order.alias("binding"), line.alias("entity_id"))).unionByName(near.select(order.alias("binding"), part.alias("entity_id")))
    customer = k("c", "o_custkey")
    references = li.select(order.alias("source"), line.alias("target")).unionByName(li.select(line.alias("source"), part.alias("target"))).unionByName(o.select(k("o", "o_orderkey").alias("source"), customer.alias("target")))
    records = o.select(k("o", "o_orderkey").alias("record_id"), F.create_map(F.lit("event.ordered"), F.col("o_orderdate").cast("timestamp")).alias("dates"), F.col("o_orderstatus").alias("stage"))
    keys = bindings.select("entity_id", F.concat(F.substring("entity_id", 1, 1), F.lit("_id")).alias("primary_key")).distinct()
    wanted = [f"p{i}" for i in range(1, 1000, 10)]
    return S.bound_records(bindings, references, records, keys, [Condition("part_id", "in", wanted)], [Condition("event.ordered", "gte", "1994-01-01")], ["F", "O"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 7 AND l_quantity > 40")
def pred_fail_uncalculable(spark, d):
    """Cells of line 7 aren't calculable; rows that other conditions leave out may hold such cells."""
    x = load(spark, d, "lineitem")
    others = [F.col("l_returnflag") == "R", F.col("l_linenumber") != 7]
    return S.uncalculable_guarded(x, others, F.col("l_quantity") > 40, F.col("l_linenumber") != 7).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_brand = 'Brand#3' AND lower(concat_ws(' ', p_name, p_type)) LIKE '%an%'")
def product_search(spark, d):
    p = load(spark, d, "part")
    catalog = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "published").otherwise("draft").alias("status"), F.col("p_brand").alias("business"), F.array(F.lit("text")).alias("modalities"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return S.searched(catalog, "published", "Brand#3", "text", "AN").select("p_partkey")


@query("""WITH k AS (SELECT lower(n_name) AS k, count(*) AS n, min(n_nationkey) AS id FROM nation GROUP BY 1) SELECT name, coalesce(n, 0)::BIGINT AS n, CASE WHEN n = 1 THEN id END::BIGINT AS id, CASE WHEN n IS NULL THEN 'SOURCE_NOT_FOUND' WHEN n > 1 THEN 'SOURCE_AMBIGUOUS' END AS issue
    FROM (SELECT upper(n_name) AS name FROM nation UNION ALL SELECT 'nowhere') LEFT JOIN (SELECT k, n * CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END AS n, id FROM k) ON lower(name) = k""")
def named_source_lookup(spark, d):
    """Each nation's file under one folder, and under a second one for every fourth."""
    n = load(spark, d, "nation")
    file = lambda folder: n.select(F.concat(F.lit(folder), "n_name").alias("path"), F.col("n_nationkey").cast("long").alias("id"))
    sources = file("a/b/").unionByName(file("c/").where("id % 4 = 0"))
    return S.named_source(sources, "path", [*[r[0].upper() for r in n.select("n_name").collect()], "nowhere"])


@query("""SELECT doc_id FROM documents WHERE source = (SELECT min(source) FROM documents) OR regexp_matches(' ' || coalesce(text, '') || ' ', '(?i)[^A-Za-z0-9_-]license[^A-Za-z0-9_-]')""")
def text_entity_filter(spark, d):
    """Texts whose entity is the target, or that name it as a whole token."""
    docs = load(spark, d, "documents")
    target = docs.agg(F.min("source")).first()[0]
    return docs.where(R.of_entity(F.col("source"), F.col("text"), target, "License")).select("doc_id")


@query("SELECT page_id, score FROM (SELECT page_id, (page_id * 37 % 101)::DOUBLE / 100 AS score, page_id % 6 AS k FROM pages) WHERE k NOT IN (1, 2, 3, 4) ORDER BY score DESC, page_id LIMIT 12")
def image_candidates(spark, d):
    """Hits of an image; four kinds are left out before the list is cut."""
    kinds = F.array(*[F.lit(x) for x in ("caption", "relation", "record", "time_series", "manifest", "paragraph")])
    hits = load(spark, d, "pages").select("page_id", ((F.col("page_id") * 37 % 101) / 100).alias("score"), F.element_at(kinds, (F.col("page_id") % 6 + 1).cast("int")).alias("kind"))
    return R.without_kinds(hits, "kind", ("relation", "record", "time_series", "manifest"), "score", "page_id", 12)


@query("""WITH c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000 ORDER BY c_custkey LIMIT 8), n AS (SELECT DISTINCT c_nationkey AS k FROM c) SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT k FROM n) ORDER BY s_suppkey LIMIT 8""")
def plan_with_dependency(spark, d):
    """A plan with two retrievers: shapes, here suppliers, of the nations of the records found first."""
    plan = QueryPlan(task_intent="x", retrievers=["structured", "geometry"], operation="filter", depends_on={"geometry": ["structured"]}, top_k=8)
    customers = structured.filtered(load(spark, d, "customer"), [Condition("c_acctbal", "gt", 5000)])
    first = customers.orderBy("c_custkey").limit(8)
    shapes = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    nations = load(spark, d, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_nationkey").alias("target"))
    found = run_all(plan, {"structured": first, "geometry": shapes}, nations, {"structured": "c_nationkey", "geometry": "s_nationkey"})
    return found["geometry"].select(F.col("id").alias("s_suppkey"))


@query("""SELECT o_orderkey, list_sort(list_distinct(regexp_extract_all(replace(lower(o_orderpriority || ' Please LIST item ' || o_orderkey), 'please list', ' '), '[a-z0-9_]{2,}')))::VARCHAR AS terms FROM orders""")
def content_terms(spark, d):
    t = F.concat("o_orderpriority", F.lit(" Please LIST item "), F.col("o_orderkey").cast("string"))
    terms = F.array_sort(X.terms(t, ["please", "please list"][1:]))
    return load(spark, d, "orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(terms, ", "), F.lit("]")).alias("terms"))
