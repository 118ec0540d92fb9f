"""Queries for data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import structured as S
from ..streaming.derived import refreshed
from .registry import load, query, scratch

CHECK = """SELECT '{rule}' AS rule, CASE WHEN coalesce(sum(ok::INT), 0) < count(ok) THEN 'FAIL' WHEN count(ok) > 0 THEN 'PASS' WHEN count(*) > 0 THEN 'NOT_ASSESSED' ELSE 'NOT_APPLICABLE' END AS status, {critical} AS critical, count(ok) AS denominator, coalesce(sum(ok::INT), 0)::BIGINT AS passed,
    (count(ok) - coalesce(sum(ok::INT), 0))::BIGINT AS n_issues, count(*) - count(ok) AS unassessed, coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT i FROM x WHERE NOT ok ORDER BY i LIMIT 100)), '') AS issues FROM x"""


def _sql(rule: str, rows: str, critical: str = "false") -> str:
    return f"WITH x AS ({rows}) " + CHECK.format(rule=rule, critical=critical)


@query(_sql("type", "SELECT p_partkey::VARCHAR AS i, try_cast(CASE WHEN p_partkey % 9 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_size::VARCHAR END AS DOUBLE) IS NOT NULL OR (p_partkey % 7 = 0 AND p_partkey % 9 <> 0) AS ok FROM part"))
def dq_schema_type(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 9 == 0, F.col("p_name")).when(k % 7 == 0, " ").otherwise(F.col("p_size").cast("string"))
    return Q.check(load(spark, d, "part"), "type", Q.has_type(text, "int|number"), k)


@query(_sql("nulls", "SELECT event_id::VARCHAR AS i, CASE WHEN event_id % 50 = 0 THEN event_id % 3 = 0 AND event_id % 4 = 0 ELSE event_id % 3 <> 0 OR event_id % 4 = 0 END AS ok FROM events"))
def dq_nulls(spark, d):
    """Blank counts as null. A field that may be null needs an explanation, whether it is null or not."""
    k = F.col("event_id")
    value, nullable, why = F.when(k % 50 == 0, "  ").otherwise(F.col("event_type")), k % 3 == 0, F.when(k % 4 == 0, "sensor off").otherwise(" ")
    return Q.check(load(spark, d, "events"), "nulls", Q.null_ok(value, nullable, why), k)


@query(_sql("time", """SELECT o_orderkey::VARCHAR AS i, CASE o_orderkey % 8 WHEN 0 THEN false WHEN 3 THEN false WHEN 4 THEN NULL WHEN 5 THEN day(o_orderdate) <= 12 WHEN 7 THEN false ELSE true END AS ok FROM orders"""))
def dq_time(spark, d):
    """No time at all, a day, a zoned instant, a declared zone that doesn't exist, a time without any zone, a day with day and
    month exchanged, a time in a declared zone, and an instant where days are declared."""
    k, day = F.col("o_orderkey") % 8, F.date_format("o_orderdate", "yyyy-MM-dd")
    clock = F.concat(day, F.lit("T10:00"))
    text = F.when(k == 0, "31/31/99").when(k == 1, day).when(k == 2, F.concat(clock, F.lit("Z"))).when(k == 5, F.date_format("o_orderdate", "yyyy-dd-MM")).when(k == 7, F.concat(clock, F.lit(":30+02:00"))).otherwise(clock)
    zone, grain = F.when(k == 3, "Mars/Olympus").when(k == 6, "Asia/Shanghai"), F.when(k.isin(1, 7), "day")
    return Q.check(load(spark, d, "orders"), "time", Q.time_ok(text, zone, grain), F.col("o_orderkey"))


@query(_sql("units", "SELECT p_partkey::VARCHAR AS i, p_partkey % 4 <> 3 AS ok FROM part WHERE p_partkey % 5 <> 4"))
def dq_units(spark, d):
    """A unit for each row; rows that say NA aren't measured."""
    k = F.col("p_partkey") % 4
    unit = F.when(F.col("p_partkey") % 5 == 4, "NA").when(k == 0, "mm").when(k == 1, "kΩ").when(k == 2, "台").otherwise("furlong")
    rows = load(spark, d, "part").withColumn("unit", unit).where("unit <> 'NA'")
    return Q.check(rows, "units", F.col("unit").isin(*Q.KNOWN_UNITS), F.col("p_partkey"))


@query(_sql("primary_key", "SELECT l_orderkey * 10 + l_linenumber || ':' || min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_orderkey) AS i, l_orderkey * 10 + l_linenumber = min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_orderkey) AS ok FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)", "true"))
def dq_primary_key(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row")).distinct()
    return Q.key_check(rows, ["l_orderkey"], "row")


@query(_sql("reference", "SELECT o_custkey::VARCHAR AS i, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) AS ok FROM orders", "true"))
def dq_references(spark, d):
    return Q.reference_check(load(spark, d, "orders"), "o_custkey", load(spark, d, "customer").where("c_custkey % 10 <> 0"), "c_custkey")


@query("SELECT count(*) AS n_edges, sum((l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0))::INT)::BIGINT AS good FROM lineitem")
def dq_relations(spark, d):
    edges = load(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("a"), F.lit(True).alias("has_a"))
    sups = load(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("b"), F.lit(True).alias("has_b"))
    x = edges.join(parts, "a", "left").join(sups, "b", "left")
    return x.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("has_a") & F.col("has_b")).alias("good"))


MANIFEST = "SELECT doc_id, sha256(text) AS h, strlen(text) AS n FROM documents"


@query(_sql("integrity", f"SELECT doc_id::VARCHAR AS i, doc_id % 200 <> 3 AS ok FROM ({MANIFEST})", "true"))
def dq_integrity(spark, d):
    docs = load(spark, d, "documents")
    files = docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))
    listed = files.select("doc_id", F.when(F.col("doc_id") % 200 == 3, "0").otherwise(F.col("sha")).alias("sha2"), F.col("size").alias("size2"))
    x = files.join(listed, "doc_id", "left")
    return Q.check(x, "integrity", F.coalesce((F.col("sha") == F.col("sha2")) & (F.col("size") == F.col("size2")), F.lit(False)), F.col("doc_id"), True)


@query("""WITH f AS (SELECT doc_id, sha256(text) AS h, strlen(text) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), b AS (SELECT i // 1000 AS b, sha256(string_agg(h, ',' ORDER BY i)) AS d FROM f GROUP BY 1)
    SELECT (SELECT sha256(string_agg(d, ',' ORDER BY b)) FROM b) AS digest, count(*) AS n, sum(f.n)::BIGINT AS bytes FROM f""")
def dq_manifest_digest(spark, d):
    """The digest of blocks of a thousand files in order, and of their digests; counts come along."""
    files = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("bytes"))
    return S.two_level_digest(files, ["doc_id"], F.col("h")).crossJoin(F.broadcast(files.agg(F.sum("bytes").alias("bytes"))))  # one row each


@query(_sql("catalog", "SELECT item_id::VARCHAR AS i, item_id % 6 <> 5 AS ok FROM benchmark"))
def dq_catalog_references(spark, d):
    b = load(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))
    entries = b.select("item_id", F.when(F.col("item_id") % 6 == 5, F.lit("x")).otherwise(F.col("h")).alias("h2"))
    x = entries.join(b, "item_id", "left")
    return Q.check(x, "catalog", F.coalesce(F.col("h") == F.col("h2"), F.lit(False)), F.col("item_id"))


@query("""WITH seen AS (SELECT DISTINCT event_type || '_' || (event_id % 7) AS field FROM events), declared AS (SELECT DISTINCT event_type || '_' || (event_id % 11) AS field FROM events)
    SELECT field, 'OBSERVED_NOT_DECLARED' AS problem FROM (SELECT * FROM seen EXCEPT SELECT * FROM declared) UNION ALL SELECT field, 'DECLARED_NOT_OBSERVED' FROM (SELECT * FROM declared EXCEPT SELECT * FROM seen)""")
def dq_schema_coverage(spark, d):
    e = load(spark, d, "events")
    fields = lambda n: e.select(F.concat_ws("_", "event_type", F.col("event_id") % n).alias("field")).distinct()
    return Q.coverage(fields(7), fields(11))


@query("""WITH p AS (SELECT p_brand AS field, min(p_type) AS published FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), r AS (SELECT p_brand AS field, max(p_type) AS requested FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
    SELECT field, published, requested, CASE WHEN published IS NULL THEN 'NOT_PUBLISHED' WHEN requested IS NULL THEN 'NOT_REQUESTED' WHEN published <> requested THEN 'CONFLICT' ELSE 'SAME' END AS verdict, coalesce(published, requested) AS effective FROM p FULL JOIN r USING (field)""")
def dq_declaration_conflict(spark, d):
    """A request can't override what is published: where the two differ, the published constraint holds."""
    p = load(spark, d, "part")
    published = p.where("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("field")).agg(F.min("p_type").alias("published"))
    requested = p.where("p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("field")).agg(F.max("p_type").alias("requested"))
    return Q.declarations(published, requested)


@query("""WITH c AS (SELECT 'a' AS rule, count(*) AS n, sum((p_size > 5)::INT) AS p, true AS critical FROM part UNION ALL SELECT 'b', count(*), count(*), false FROM orders)
    SELECT sum(n)::BIGINT AS measured, sum(p)::BIGINT AS passed, sum((critical AND p < n)::INT)::BIGINT AS blocking, 1::BIGINT AS unassessed, round(100.0 * sum(p) / sum(n), 4)::DOUBLE AS score,
    CASE WHEN sum(p) < sum(n) THEN 'FAILED' ELSE 'PARTIAL' END AS verdict FROM c""")
def quality_score(spark, d):
    a = Q.check(load(spark, d, "part"), "a", F.col("p_size") > 5, F.col("p_partkey"), True)
    b = Q.check(load(spark, d, "orders"), "b", F.col("o_orderkey").isNotNull(), F.col("o_orderkey"))
    return Q.scored(reduce(lambda x, y: x.unionByName(y), [a, b, Q.not_assessed(a, "c")]))


@query("SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def identical_hash_groups(spark, d):
    return load(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT p_name AS entity, count(DISTINCT p_brand) AS n_paths FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def cross_format_entities(spark, d):
    return load(spark, d, "part").groupBy(F.col("p_name").alias("entity")).agg(F.count_distinct("p_brand").alias("n_paths")).where("n_paths > 1")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.doc_id % 5 <> 0 AND l.doc_id % 7 <> 0)")
def incremental_reuse(spark, d):
    """Documents that must be parsed: those that no earlier run has under the same path, hash and version.

    The earlier run saw other contents of every fifth document and had an older parser for every seventh."""
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.lit("2").alias("version"))
    done = docs.join(load(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    done = done.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2("sha", 256)).otherwise(F.col("sha")).alias("sha"), F.when(F.col("doc_id") % 7 == 0, "1").otherwise("2").alias("version"))
    return docs.join(done, ["doc_id", "sha", "version"], "left_anti").select("doc_id")


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT count(*) AS n, count(DISTINCT t) AS d FROM t WHERE doc_id % 2 = 0), b AS (SELECT count(*) AS n, count(DISTINCT t) FILTER (t NOT IN (SELECT t FROM t WHERE doc_id % 2 = 0)) AS d FROM t)
    SELECT 1 AS run, a.n AS n_rows, a.d AS parsed FROM a UNION ALL SELECT 2, 0, 0 UNION ALL SELECT 3, b.n, b.d FROM b""")
def content_reuse(spark, d):
    """Documents put into a folder by halves, with a run after each and one between: rows read, and contents parsed."""
    files, store = scratch(spark), scratch(spark)
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    runs = []
    for part in (docs.where("path % 2 = 0"), None, docs):
        if part is not None:
            part.write.mode("append").parquet(files)
        found = refreshed(spark, files, store, "1", lambda new: new.select("sha", F.size(F.split("content", " ")).alias("words")))
        runs.append((len(runs) + 1, found["rows"], found["parsed"]))
    return spark.createDataFrame(runs, "run int, n_rows long, parsed long")
