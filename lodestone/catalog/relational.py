"""Queries over entities, versions, relations and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relations as R
from ..plans.compile import dependent
from ..sources import readers
from .registry import load, query


@query("""SELECT c_custkey, o_orderkey, l_linenumber, n_name, r_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND o_orderdate < DATE '1995-06-01'""")
def inner_join_n(spark, d):
    c, o, l, n, r = (load(spark, d, t) for t in ("customer", "orders", "lineitem", "nation", "region"))
    asia = n.join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey)
    x = o.where(F.col("o_orderdate") < "1995-06-01").join(c, o.o_custkey == c.c_custkey).join(asia, c.c_nationkey == n.n_nationkey)
    return x.join(l, l.l_orderkey == o.o_orderkey).select("c_custkey", "o_orderkey", "l_linenumber", "n_name", "r_name")


@query("""SELECT DISTINCT c_custkey, n_name, o_orderpriority FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def left_join_n(spark, d):
    c, n, o, s, r = (load(spark, d, t) for t in ("customer", "nation", "orders", "supplier", "region"))
    x = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(o.where("o_orderstatus = 'P'"), F.col("o_custkey") == c.c_custkey, "left")
    return x.join(s, s.s_suppkey == c.c_custkey, "left").join(r, r.r_regionkey == n.n_regionkey, "left").select("c_custkey", "n_name", "o_orderpriority").distinct()


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1) ON o_custkey = c_custkey""")
def lateral_top1(spark, d):
    top = R.newest(load(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")])
    c = load(spark, d, "customer")
    return c.join(top, c.c_custkey == top.o_custkey, "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(spark, d):
    o = load(spark, d, "orders").where("o_totalprice > 400000")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_not_exists(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus = 'F'")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'draft' ELSE 'published' END AS state FROM customer")
def case_exists(spark, d):
    draft = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("draft", F.lit(True))
    return load(spark, d, "customer").join(draft, "c_custkey", "left").select("c_custkey", F.when(F.col("draft"), "draft").otherwise("published").alias("state"))


@query("SELECT c_custkey, coalesce((SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey), TIMESTAMP '1990-01-01') AS last_order FROM customer")
def coalesce_scalar_subquery(spark, d):
    last = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("m"))
    x = load(spark, d, "customer").join(last, "c_custkey", "left")
    return x.select("c_custkey", F.coalesce(F.col("m").cast("timestamp"), F.lit("1990-01-01").cast("timestamp")).cast("timestamp_ntz").alias("last_order"))


@query("SELECT DISTINCT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def join_relation_dependency(spark, d):
    relations = load(spark, d, "nation").join(load(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("source"), F.col("c_custkey").alias("target"))
    source = load(spark, d, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    return dependent(source, relations, load(spark, d, "customer"), "r_regionkey", "c_custkey").select("c_custkey")


@query("SELECT DISTINCT l_orderkey AS asset, p_brand AS entity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#2', 'Brand#17')")
def join_entity_binding(spark, d):
    binding = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("asset")).agg(F.collect_set("l_partkey").alias("entity_ids"))
    p = load(spark, d, "part").where(F.col("p_brand").isin("Brand#2", "Brand#17"))
    return binding.select("asset", F.explode("entity_ids").alias("p_partkey")).join(p, "p_partkey").select("asset", F.col("p_brand").alias("entity")).distinct()


@query("SELECT c_custkey AS key, count(o_orderkey) AS matches, CASE count(o_orderkey) WHEN 0 THEN 'ROW_NOT_FOUND' WHEN 1 THEN NULL ELSE 'ROW_AMBIGUOUS' END AS issue FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_catalog_row(spark, d):
    return R.catalog_row(load(spark, d, "customer").select(F.col("c_custkey").alias("key")), load(spark, d, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("SELECT l_orderkey AS source, l_suppkey AS target, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT s_suppkey FROM supplier) AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY ALL")
def join_relation_verify(spark, d):
    edges = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"))
    return R.verified_edges(edges, load(spark, d, "supplier").select("s_suppkey"), "s_suppkey").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


EDGES = "SELECT DISTINCT l_orderkey AS source, l_orderkey // 3 AS target FROM lineitem WHERE l_orderkey > l_orderkey // 3"


@query(f"WITH RECURSIVE e AS ({EDGES}), r(start, node) AS (SELECT DISTINCT source, source FROM e UNION SELECT r.start, e.target FROM r JOIN e ON r.node = e.source) SELECT start, node FROM r")
def graph_reachability(spark, d):
    """Edges from each order to the one that its number leads to in base 3: paths are short, and none returns."""
    edges = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.floor(F.col("l_orderkey") / 3).alias("target")).where("source > target").distinct()
    return R.reachable(edges, edges.select(F.col("source").alias("start")).distinct())


@query("WITH RECURSIVE e AS (SELECT p_partkey AS source, p_partkey // 2 AS target FROM part WHERE p_partkey > 0), r(start, node) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.start, e.target FROM r JOIN e ON r.node = e.source) SELECT start, count(*) AS n, min(node) AS root FROM r GROUP BY start")
def graph_closure_sku(spark, d):
    p = load(spark, d, "part")
    edges = p.where("p_partkey > 0").select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 2).alias("target"))
    return R.reachable(edges, p.select(F.col("p_partkey").alias("start"))).groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("root"))


@query("""WITH RECURSIVE b AS (SELECT 'b' || s_suppkey AS id, 'p' || s_suppkey AS part, 's' || s_nationkey AS sku FROM supplier), own AS (SELECT 's' || n_nationkey AS id, 's' || n_nationkey AS sku FROM nation UNION SELECT id, sku FROM b UNION SELECT part, sku FROM b WHERE part IN (SELECT 'p' || p_partkey FROM part)),
    e AS (SELECT 'c' || c_custkey AS id, t AS target FROM customer, LATERAL (SELECT unnest(CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey IN (SELECT p_partkey FROM part) THEN ['p' || c_custkey] ELSE ['b' || (c_custkey % 7 + 1)] END WHEN 1 THEN ['c' || (c_custkey + 1)] ELSE ['c' || (c_custkey - 1), 'c' || (c_custkey + 1)] END) AS t) u
        WHERE t IN (SELECT 'p' || p_partkey FROM part UNION ALL SELECT id FROM b UNION ALL SELECT 'c' || c_custkey FROM customer) UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
    r(id, sku) AS (SELECT id, sku FROM own UNION SELECT e.id, r.sku FROM r JOIN e ON r.id = e.target) SELECT id AS entity_id, sku AS product FROM r""")
def product_tiers(spark, d):
    """Nations as products, suppliers as bills of materials, parts, customers as batches and orders as lines of them.

    A batch names a part and a bill: the part's tier comes first where the part is known, though most parts are in no bill.
    Other batches name each other in circles, and take what the batch beside the circle has."""
    k = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    fields = lambda **xs: F.create_map(*[x for n, v in xs.items() for x in (F.lit(n), v)])
    entity = lambda table, i, key, f: load(spark, d, table).select(i.alias("entity_id"), F.lit(key).alias("primary_key"), f.alias("fields"))
    c = F.col("c_custkey")
    batch = F.when(c % 3 == 0, fields(part_id=F.array(k("p", c)), bom_id=F.array(k("b", c % 7 + 1)))).when(c % 3 == 1, fields(finished_batch_id=F.array(k("c", c + 1)))).otherwise(fields(manufacturing_batch_id=F.array(k("c", c - 1), k("c", c + 1))))
    rows = [
        entity("nation", k("s", "n_nationkey"), "sku_id", fields(sku_id=F.array(k("s", "n_nationkey")))),
        entity("supplier", k("b", "s_suppkey"), "bom_id", fields(bom_id=F.array(k("b", "s_suppkey")), part_id=F.array(k("p", "s_suppkey")), sku_id=F.array(k("s", "s_nationkey")))),
        entity("part", k("p", "p_partkey"), "part_id", fields(part_id=F.array(k("p", "p_partkey")))),
        entity("customer", k("c", c), "batch_id", batch),
        entity("orders", k("o", "o_orderkey"), "line_id", fields(supplier_batch_id=F.array(k("c", "o_custkey")))),
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return R.product_links(every)


@query("""WITH w AS (SELECT l_orderkey AS page, l_linenumber AS line, unnest(range(3)) AS col, 100.0 * unnest(range(3)) + (l_partkey % 4) * 0.75 AS x0, 20.0 * l_linenumber AS y0 FROM lineitem)
    SELECT page, coalesce(header, '') AS header, count(*) AS n FROM (SELECT page, CASE WHEN line = 0 THEN NULL WHEN x0 - 100 * col <= 1.5 THEN ['qty', 'price', 'tax'][col + 1] END AS header FROM w UNION ALL SELECT DISTINCT page, NULL FROM w UNION ALL SELECT DISTINCT page, NULL FROM w UNION ALL SELECT DISTINCT page, NULL FROM w) GROUP BY ALL""")
def band_columns(spark, d):
    """Orders as pages: a line of headings, and a line of words for each item, some of them too far to the right."""
    i, lines = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col"), load(spark, d, "lineitem")
    w = lines.select(F.col("l_orderkey").alias("page"), F.monotonically_increasing_id().alias("row"), "l_linenumber", "l_partkey", i)
    heads = lines.select(F.col("l_orderkey").alias("page")).distinct().select("page", i)
    box = lambda block, key, x, y, text: (block.cast("long").alias("block"), key.alias("id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (y + 8).cast("double").alias("y1"), text.alias("text"))
    items = w.select("page", *box(F.col("row") + 1, F.col("row") * 3 + F.col("col") + 3, F.col("col") * 100 + F.col("l_partkey") % 4 * 0.75, F.col("l_linenumber") * 20, F.lit("x"))).withColumn("block", F.lit(None).cast("long"))
    names = F.element_at(F.array(*map(F.lit, ("qty", "price", "tax"))), F.col("col") + 1)
    top = heads.select("page", *box(F.lit(0), -F.col("col") - 1, F.col("col") * 100, F.lit(0), names))
    found = R.band_columns(top.unionByName(items))
    return found.groupBy("page", F.coalesce("header", F.lit("")).alias("header")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT o_custkey AS k, min(o_orderstatus) AS v0 FROM orders GROUP BY 1 HAVING count(*) = 1), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'P' END AS v1 FROM customer),
    c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'F' ELSE 'P' END AS v2 FROM customer), e AS (SELECT c_custkey AS k, 'F' AS v3 FROM customer)
    SELECT k, v0, v1, v2, v3, v0 = v1 AND v0 = v2 AND v0 = v3 AS agree FROM a JOIN b USING (k) JOIN c USING (k) JOIN e USING (k)""")
def same_key_record_compare(spark, d):
    """Four sources; a key that repeats in one of them isn't compared."""
    a = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"))
    c = load(spark, d, "customer")
    of = lambda n: c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % n == 0, "F").otherwise("P").alias("v"))
    return R.same_key([a, of(2), of(3), of(1)], "k", "v")


@query("""WITH u AS (SELECT n_nationkey AS k, 10 * n_nationkey AS used, 120 AS quota FROM nation) SELECT k, CASE WHEN used + c <= quota THEN used + c ELSE used END::BIGINT AS used, used + c <= quota AS changed FROM u JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = k""")
def update_from_join(spark, d):
    u = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (10 * F.col("n_nationkey")).alias("old"), F.lit(120).alias("quota"))
    delta = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    fits = F.col("old") + F.col("c") <= F.col("quota")
    return u.join(delta, "k").select("k", F.when(fits, F.col("old") + F.col("c")).otherwise(F.col("old")).cast("long").alias("used"), fits.alias("changed"))


@query("SELECT o_orderkey, count(*) AS n, min(e.event_id) AS first_id, sum(e.event_id)::BIGINT AS total FROM orders JOIN events e ON e.user_id = o_custkey AND e.ts >= o_orderdate + INTERVAL 23 YEAR AND e.ts < o_orderdate + INTERVAL 30 YEAR GROUP BY 1")
def range_window_join(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 23 YEAR")).alias("a"), (F.col("o_orderdate") + F.expr("INTERVAL 30 YEAR")).alias("b"))
    e = load(spark, d, "events")
    return o.join(e, (e.user_id == o.o_custkey) & (e.ts >= o.a) & (e.ts < o.b)).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.sum("event_id").alias("total"))


@query("""WITH b AS (SELECT l_orderkey // 40 AS page, l_orderkey * 10 + l_linenumber AS id, l_extendedprice % 100 AS y0, l_extendedprice % 100 + l_quantity * 2 AS y1 FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey))
    SELECT x.page, x.id AS a, y.id AS b FROM b x JOIN b y ON x.page = y.page AND x.id < y.id AND abs(x.y0 - y.y0) <= 1.5 AND abs(x.y1 - y.y1) <= 1.5 WHERE x.y1 - x.y0 <= 64 AND y.y1 - y.y0 <= 64""")
def band_self_join(spark, d):
    """Line items as boxes on pages of forty orders."""
    y0 = F.col("l_extendedprice") % 100
    rows = R.newest(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.asc("l_partkey")])
    return R.band_join(rows.select(F.floor(F.col("l_orderkey") / 40).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), y0.alias("y0"), (y0 + F.col("l_quantity") * 2).alias("y1")))


@query("SELECT o_orderkey, c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30) JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def asset_enrich(spark, d):
    top = load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)
    c = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return top.join(c, top.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS place, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def active_version_pick(spark, d):
    place = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    o = load(spark, d, "orders").withColumn("place", place)
    return R.newest(o, ["o_custkey"], [F.asc("place"), F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "place", "o_orderkey")


@query("SELECT n_nationkey AS k, count(DISTINCT c_mktsegment) AS segments, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS names FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
def array_agg_filter(spark, d):
    c = load(spark, d, "customer").where("c_acctbal > 9000")
    x = load(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy(F.col("n_nationkey").alias("k")).agg(F.count_distinct("c_mktsegment").alias("segments"), F.array_sort(F.collect_set("c_mktsegment")).alias("s"))
    return x.select("k", "segments", F.when(F.size("s") > 0, F.array_join("s", ",")).alias("names"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem")
def count_distinct(spark, d):
    return load(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey", "l_suppkey").alias("pairs"))


@query("SELECT n_nationkey::BIGINT AS k, n_regionkey::DOUBLE AS v, false AS inserted FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal, s_suppkey NOT IN (SELECT n_nationkey FROM nation) FROM supplier")
def upsert(spark, d):
    old = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("double").alias("v"))
    new = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return R.upserted(old, new, ["k"])


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation UNION ALL SELECT s_suppkey, min(s_name) FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1")
def insert_ignore(spark, d):
    return R.inserted_if_new(load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), ["k"])


@query("SELECT p_name AS path, p_size AS size FROM (SELECT p_partkey || p_name AS p_name, CASE WHEN p_partkey % 5 = 1 THEN -1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 0)")
def commit_overlay(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), "p_name").alias("path"), F.col("p_size").alias("size"))
    k = F.col("p_partkey") % 5
    changes = p.where(k <= 1).select("path", F.lit(-1).alias("size"), F.when(k == 0, "remove").otherwise("replace").alias("action"))
    return R.overlaid(p.select("path", "size"), changes, "path")


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier ORDER BY k LIMIT 40")
def union_all(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).unionByName(load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))).orderBy("k").limit(40)


@query("SELECT n_nationkey AS k, n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def concat_frames(spark, d):
    a = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    b = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersect_ids(spark, d):
    o = load(spark, d, "orders")
    ids = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return ids("F").intersect(ids("P"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct(spark, d):
    return load(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey LIMIT 25")
def nulls_last(spark, d):
    return load(spark, d, "orders").orderBy(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).desc_nulls_last(), "o_orderkey").select("o_orderkey", "o_orderdate").limit(25)


@query("""SELECT o_orderstatus AS status, count(*) AS n, sum((o_totalprice > 200000)::INT)::BIGINT AS large, round(avg(o_totalprice::DECIMAL(18,4)), 4)::DOUBLE AS average_price FROM orders GROUP BY 1""")
def kpi_rollup(spark, d):
    return load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.round(F.avg(F.col("o_totalprice").cast("decimal(18,4)")), 4).cast("double").alias("average_price"))


@query("""SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source""")
def format_counts(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("""WITH x AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS r, count(*) OVER () AS n FROM lineitem WHERE l_orderkey BETWEEN 50 AND 60)
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, true AS in_page, n > 32 AS has_more, (SELECT l_orderkey * 10 + l_linenumber FROM x WHERE r = 33) AS next_row FROM x WHERE r <= 32""")
def read_table(spark, d):
    """A page of at most 32 rows, whether there are more, and where the next page starts."""
    x = load(spark, d, "lineitem").where(F.col("l_orderkey").between(50, 60)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return R.page(x, ["l_orderkey", "l_linenumber", "l_partkey"], F.col("l_orderkey") * 10 + F.col("l_linenumber"), 32)


@query("SELECT n_name AS book, unnest(['A2', 'B9', 'AB2']) AS cell, unnest([n_name, NULL, (n_nationkey * 2)::VARCHAR]) AS value, unnest([false, true, false]) AS missing FROM nation")
def read_workbook_cells(spark, d):
    """Named cells of each workbook; one that isn't there is listed as missing, not as zero."""
    books = load(spark, d, "nation").select(F.col("n_name").alias("path"), readers.sample_workbook("n_name", F.col("n_nationkey")).alias("content"))
    wanted = books.select(F.col("path").alias("book"), F.explode(F.array(*map(F.lit, ("A2", "B9", "AB2")))).alias("cell")).withColumn("at", X.cell_place(F.col("cell")))
    cells = readers.read_xlsx(books)
    found = wanted.join(cells, (F.col("book") == F.col("path")) & (F.col("at.row") == F.col("row")) & (F.col("at.col") == F.col("column")), "left")
    return found.select("book", "cell", "value", F.col("path").isNull().alias("missing"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_linenumber = 2 AND l_quantity < 20 AND l_quantity + 5 > 12 AND l_discount * 100 < 6 AND l_discount * 100 + 2 > 3 ORDER BY id LIMIT 256")
def read_region_text(spark, d):
    x0, y0 = F.col("l_quantity"), F.col("l_discount") * 100
    hit = (x0 < 20) & (x0 + 5 > 12) & (y0 < 6) & (y0 + 2 > 3)
    return load(spark, d, "lineitem").where((F.col("l_linenumber") == 2) & hit).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).orderBy("id").limit(256)


@query("SELECT min(event_id) AS event_id FROM events WHERE event_type = 'error' AND ts = (SELECT min(ts) FROM events WHERE event_type = 'error')")
def oldest_due_task(spark, d):
    e = load(spark, d, "events").where("event_type = 'error'")
    return e.orderBy("ts", "event_id").limit(1).select("event_id")
