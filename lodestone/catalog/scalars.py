"""Queries over functions on records, times, units and boxes, and over bounded reads and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as J
from ..functions import text as X
from ..functions import times, units
from ..operators import exact as E
from ..operators import structured as S
from ..operators import timeseries as T
from ..sources import readers, sinks
from ..streaming.resample import new_tasks
from .registry import load, query, scratch
from .timeseries import facts


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1704103200000000 WHEN 1 THEN 1704110400123456 END::BIGINT AS micros FROM events""")
def strict_clock(spark, d):
    """A zoned time, one in a declared zone, one that the zone skips, one that it has twice, one finer than microseconds."""
    rows = (("2024-01-01T12:00:00+02:00", None), ("2024-01-01T07:00:00.123456", "America/New_York"), ("2024-03-10T02:30:00", "America/New_York"), ("2024-11-03T01:30:00", "America/New_York"), ("2024-01-01T12:00:00.1234567Z", None))
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in rows]), (F.col("event_id") % 5 + 1).cast("int"))
    return load(spark, d, "events").select("event_id", times.strict_clock(pick(0), pick(1)).alias("micros"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN NULL WHEN 4 THEN NULL ELSE p_partkey % 6 <> 3 END AS same FROM part""")
def record_unit_equality(spark, d):
    """kW and W, degrees and kelvin, mm³ and mL, one that differs, other dimensions, an unknown unit."""
    k, v = F.col("p_partkey") % 6, F.col("p_size").cast("decimal(18,6)")
    case = lambda *xs: F.element_at(F.array(*xs), (k + 1).cast("int"))
    a, ua = case(v, v, v * 1000, v, v, v), case(*map(F.lit, ("kW", "°C", "mm³", "h", "kg", "furlong")))
    b, ub = case(v * 1000, v + F.lit("273.15").cast("decimal(9,2)"), v, v * 3600 + 1, v, v), case(*map(F.lit, ("W", "K", "mL", "s", "m", "m")))
    x = load(spark, d, "part").select("p_partkey", a.cast("decimal(24,6)").alias("a"), ua.alias("ua"), b.cast("decimal(24,6)").alias("b"), ub.alias("ub"))
    return x.select("p_partkey", units.record_values_equal([(F.col("a"), F.col("ua")), (F.col("b"), F.col("ub"))]).alias("same"))


@query("SELECT p_partkey, p_partkey % 4 <> 0 AS same FROM part")
def record_group_equality(spark, d):
    """Four sources, the first compared with each of the others."""
    v = F.col("p_size").cast("decimal(18,6)")
    off = F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)
    values = [(v, F.lit("km")), (v * 1000, F.lit("m")), (v * 100_000 + off, F.lit("cm")), (v * 1_000_000, F.lit("mm"))]
    return load(spark, d, "part").select("p_partkey", units.record_values_equal(values).alias("same"))


@query("SELECT l_returnflag AS flag, CASE WHEN l_returnflag = 'R' THEN 'NEEDS_UNIT_MAPPING' ELSE 'OK' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def sort_unit_guard(spark, d):
    """Rows of more than one unit have no order by their numbers."""
    x = load(spark, d, "lineitem").withColumn("unit", F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 1), "cm").otherwise("m"))
    return x.groupBy(F.col("l_returnflag").alias("flag")).agg(S.order_status(F.col("unit")).alias("status"), F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT l_orderkey AS k, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 5 AS x1, l_discount * 100 + 3 AS y1 FROM lineitem)
    SELECT k, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(greatest(0, least(max(x1), 30) - greatest(min(x0), 10)) * greatest(0, least(max(y1), 6) - greatest(min(y0), 2)), 6) AS shared FROM b GROUP BY k""")
def bbox_union_overlap(spark, d):
    x0, y0 = F.col("l_quantity"), F.col("l_discount") * 100
    x = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(J.box_around(x0, y0, x0 + 5, y0 + 3).alias("u"))
    page = F.struct(*[F.lit(v).alias(n) for n, v in (("x0", 10.0), ("y0", 2.0), ("x1", 30.0), ("y1", 6.0))])
    return x.select("k", "u.*", F.round(J.box_overlap(F.col("u"), page), 6).alias("shared"))


@query("SELECT user_id AS k, round(avg(exp(-value / 100)), 6) AS confidence FROM events GROUP BY 1")
def token_confidence(spark, d):
    return load(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.round(J.mean_probability(-F.col("value") / 100), 6).alias("confidence"))


def _records(spark, d):
    """A record of each part: lists of objects with a field that is set, null or missing by size, tags, deep and odd places."""
    k, size = F.col("p_partkey"), F.col("p_size")
    one = F.when(size % 3 == 0, F.lit('{"c":null}')).when(size % 3 == 1, F.concat(F.lit('{"c":'), size.cast("string"), F.lit("}"))).otherwise(F.lit('{"d":2}'))
    b = F.array_join(F.transform(F.sequence(F.lit(1), k % 4 + 1), lambda i: one), ",")
    named = F.to_json(F.struct(F.col("p_name").alias("name"), F.array(F.col("p_brand"), F.lit('z "q"\\')).alias("tags")))
    deep = F.when(k % 5 == 0, F.lit(',"u":{"v":{"w":{"x":{"y":{"z":"end"}}}}}')).otherwise("")
    text = F.concat(F.lit('{"a":{"b":['), b, F.lit("]}"), deep, F.lit(',"m":'), named, F.lit("}"))
    return load(spark, d, "part").select(k.alias("id"), text.alias("text")).withColumn("record", F.parse_json("text"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 < 2 THEN p_partkey % 4 + 1 ELSE 0 END::INT AS n, CASE WHEN p_size % 3 = 0 THEN p_partkey % 4 + 1 ELSE 0 END::INT AS nulls FROM part")
def declared_nested_path(spark, d):
    """Values and nulls under a.b[].c: a missing field isn't a null."""
    x = _records(spark, d).select("id", J.nested(F.col("record"), "a.b[].c").alias("v"))
    return x.select("id", F.size("v").alias("n"), F.size(F.filter("v", lambda v: F.is_variant_null(v))).alias("nulls"))


@query("""SELECT path, n FROM (SELECT unnest(['a', 'a.b', 'm', 'm.name', 'm.tags']) AS path, count(*) AS n FROM part UNION ALL SELECT 'a.b[].c', sum((p_size % 3 < 2)::INT)::BIGINT FROM part UNION ALL SELECT 'a.b[].d', sum((p_size % 3 = 2)::INT)::BIGINT FROM part
    UNION ALL SELECT unnest(['u', 'u.v', 'u.v.w', 'u.v.w.x', 'u.v.w.x.y', 'u.v.w.x.y.z']), sum((p_partkey % 5 = 0)::INT)::BIGINT FROM part) WHERE n > 0""")
def observed_field_paths(spark, d):
    return J.field_paths(_records(spark, d), "record")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'end|' ELSE '' END || p_name || '|' || p_brand || '|z "q"\\' AS leaves FROM part""".replace("\\\\", "\\"))
def string_leaves(spark, d):
    return _records(spark, d).select("id", F.array_join(J.string_leaves(F.col("text")), "|").alias("leaves"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_type FROM events")
def decoded_json_cells(spark, d):
    """Cells of a column named props_json; every third is no JSON."""
    broken = F.when(F.col("event_id") % 3 == 0, F.substring("props", 2, 100)).otherwise(F.col("props"))
    cells = J.decoded_cells({"props_json": broken, "event_type": F.col("event_type")})
    return load(spark, d, "events").select("event_id", F.try_variant_get(cells["props"], "$.k", "bigint").alias("k"), cells["event_type"].alias("event_type"))


@query("SELECT l_orderkey AS k, count(*) AS n, max(l_linenumber) AS last, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, 'done' AS state FROM lineitem GROUP BY 1")
def json_objects(spark, d):
    """An object built for each line, aggregated to a list, a field set in it, and read again."""
    line = F.struct("l_linenumber", "l_returnflag")
    x = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(line).alias("lines"))
    state = F.map_concat(F.create_map(F.lit("state"), F.lit("new")), F.create_map(F.lit("n"), F.size("lines").cast("string")))
    merged = F.map_zip_with(state, F.create_map(F.lit("state"), F.lit("done")), lambda k, a, b: F.coalesce(b, a))
    record = F.parse_json(F.to_json(F.struct("lines", merged.alias("meta"))))
    items = F.try_variant_get("r", "$.lines", "array<struct<l_linenumber:int,l_returnflag:string>>")
    y = x.select("k", record.alias("r")).select("k", "r", items.alias("i"))
    flags = F.array_join(F.array_sort(F.array_distinct(F.transform("i", lambda v: v["l_returnflag"]))), ",")
    return y.select("k", F.try_variant_get("r", "$.meta.n", "bigint").alias("n"), F.array_max(F.transform("i", lambda v: v["l_linenumber"])).alias("last"), flags.alias("flags"), F.try_variant_get("r", "$.meta.state", "string").alias("state"))


@query("SELECT doc_id, md5('v1:' || doc_id) AS short, sha256('{\"id\":' || doc_id || ',\"v\":1}') AS long FROM documents")
def deterministic_ids(spark, d):
    """Identifiers that depend on nothing but a name; uuid_of is tested in tests/test_scalars.py."""
    k = F.col("doc_id").cast("string")
    return load(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("v1:"), k)).alias("short"), F.sha2(F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit(1).alias("v"))), 256).alias("long"))


@query("SELECT page_id, nullif(trim(regexp_replace(CASE WHEN page_id % 4 = 0 THEN ' ' ELSE '  ' || url || chr(10) || ' x ' END, '\\s+', ' ', 'g')), '') AS label FROM pages")
def normalised_text(spark, d):
    raw = F.when(F.col("page_id") % 4 == 0, " ").otherwise(F.concat(F.lit("  "), "url", F.lit("\n x ")))
    return load(spark, d, "pages").select("page_id", J.normalised(raw).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN (p_size // 10)::VARCHAR ELSE (p_size // 10)::VARCHAR || '.' || (p_size % 10)::VARCHAR END AS text FROM part")
def compact_decimals(spark, d):
    return load(spark, d, "part").select("p_partkey", J.compact_decimal((F.col("p_size").cast("decimal(20,3)") / 10).cast("decimal(20,6)")).alias("text"))


@query("SELECT o_orderkey, 'order ' || o_orderkey || ' total' AS question FROM orders")
def output_instructions(spark, d):
    asked = F.concat(F.lit("Answer in JSON. order "), F.col("o_orderkey").cast("string"), F.lit(" total, answer briefly please"))
    bare = J.without_output_instructions(asked, ["answer in json\\.?", ",? *answer briefly", "please"])
    return load(spark, d, "orders").select("o_orderkey", bare.alias("question"))


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct([strftime(o_orderdate, '%Y-%m-%d'), '1996-02-03'])), ',') AS up, CASE o_orderkey % 3 WHEN 0 THEN 'Asia/Shanghai' WHEN 1 THEN '+08:00' END AS zone, CASE o_orderkey % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'context' END AS role FROM orders")
def temporal_literals(spark, d):
    """Dates that a text names, the zone that a sheet declares, and what a date field tells of."""
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 3
    text = F.concat(F.lit("due 1996-02-03, placed "), day, F.lit(" (not 11996-02-031), again "), day)
    zone = F.when(k == 0, "Time zone: Asia/Shanghai").when(k == 1, "时区：+08:00").otherwise("zone unknown")
    field = F.when(k == 0, "shipped_at").when(k == 1, "contract_valid_to").otherwise("amount")
    return load(spark, d, "orders").select("o_orderkey", F.array_join(J.dates_in(text), ",").alias("up"), J.declared_zone(zone).alias("zone"), J.date_role(field).alias("role"))


@query("SELECT event_type AS metric, count(*) AS n, round(sum(value::DECIMAL(38,12))::DOUBLE, 6) AS once, round(sum(value::DECIMAL(38,12))::DOUBLE, 6) AS again, round(sum(value::DECIMAL(38,12))::DOUBLE, 6) AS exact FROM events GROUP BY 1")
def exact_ts_recompute(spark, d):
    """Totals in decimals, as the last of a running sum, and as a rational: three ways that must come to the same."""
    f = facts(spark, d)
    once = T.totals(f, ["metric"]).select("metric", "n", F.round("sum_value", 6).alias("once"))
    again = T.running_total(f, "metric").select("metric", F.round("total", 6).alias("again"))
    exact = E.exact_totals(f, F.col("value"), ["metric"]).select("metric", F.round("sum_value", 6).alias("exact"))
    return once.join(again, "metric").join(exact, "metric")


@query("SELECT o_custkey AS k, count(*) AS n, least(count(*), 5) AS kept, count(*) > 5 AS cut, (list(o_orderkey ORDER BY o_orderkey) [1:5])::VARCHAR AS inputs FROM orders GROUP BY 1")
def calculation_receipts(spark, d):
    """The first inputs of each total, in order, and whether there are more."""
    x = S.receipts(load(spark, d, "orders"), ["o_custkey"], "o_orderkey", 5)
    return x.select(F.col("o_custkey").alias("k"), "n", F.size("inputs").cast("long").alias("kept"), (F.col("n") > 5).alias("cut"), F.concat(F.lit("["), F.array_join(F.transform("inputs", lambda v: v.cast("string")), ", "), F.lit("]")).alias("inputs"))


@query("SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN length(text) END AS n, turn % 2 = 0 AS has_text FROM conversations")
def read_json_record_table(spark, d):
    """Records read field by field; a field that isn't there is told from one that is null."""
    c = load(spark, d, "conversations")
    even = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    r = c.select(F.parse_json(F.when(F.col("turn") % 2 == 0, even).otherwise(F.to_json(F.struct("conv_id", "turn", "role")))).alias("record"))
    get = lambda p, kind: F.try_variant_get("record", X.json_pointer(p), kind)
    return r.select(get("/conv_id", "bigint").alias("conv_id"), get("/turn", "bigint").alias("turn"), get("/role", "string").alias("role"), F.length(get("/text", "string")).cast("long").alias("n"), get("/text", "variant").isNotNull().alias("has_text"))


@query("SELECT p_partkey, unnest(['brand', 'colour', 'size']) AS name, unnest([p_brand, NULL, p_size::VARCHAR]) AS value, unnest([false, true, false]) AS missing FROM part")
def read_properties(spark, d):
    """Three properties by name, one of which no part has."""
    held = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"), F.lit("kind"), "p_type")
    x = load(spark, d, "part").select("p_partkey", held.alias("held"), F.explode(F.array(*map(F.lit, ("brand", "colour", "size")))).alias("name"))
    return x.select("p_partkey", "name", F.try_element_at("held", "name").alias("value"), (~F.map_contains_key("held", F.col("name"))).alias("missing"))


@query("SELECT n_regionkey AS region, count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY 1")
def write_records(spark, d):
    """Records with their schema and field index beside them, read back by both."""
    path = scratch(spark)
    sinks.write_records(load(spark, d, "nation"), path)
    fields = {r["field"]: r["type"] for r in spark.read.json(f"{path}/fields").collect()}
    kept = [f for f in ("n_regionkey", "n_nationkey") if fields[f] == "int"]
    return spark.read.parquet(f"{path}/records").select(*kept).groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("total"))


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings")
def write_id_map(spark, d):
    """Places of vectors in an index, from 0 in the order of their ids, written and read back."""
    path = scratch(spark)
    S.numbered(load(spark, d, "embeddings").select("vec_id"), ["vec_id"], "place").write.parquet(path)
    return spark.read.parquet(path).select("vec_id", F.col("place").cast("long").alias("place"))


@query("SELECT label, count(*) AS n, round(sum(e[1] / sqrt(list_dot_product(e, e))), 6) AS first_sum, round(sum(list_dot_product(e, e) / list_dot_product(e, e)), 6) AS squares FROM (SELECT label, embedding::DOUBLE[] AS e FROM embeddings) WHERE list_dot_product(e, e) > 0 GROUP BY 1")
def write_vector_index(spark, d):
    """Vectors of length one by space, written and read back."""
    path = scratch(spark)
    sinks.write_vectors(load(spark, d, "embeddings"), "vec_id", "embedding", "label", path)
    x = spark.read.parquet(path)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    return x.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("embedding", 0)), 6).alias("first_sum"), F.round(F.sum(length), 6).alias("squares"))


@query("SELECT n_name AS sheet, 1 AS row, 1 AS col, 'name' AS value, NULL::VARCHAR AS formula FROM nation UNION ALL SELECT n_name, 1, 2, 'k', NULL FROM nation UNION ALL SELECT n_name, 2, 1, n_name, NULL FROM nation UNION ALL SELECT n_name, 2, 28, (n_nationkey * 2)::VARCHAR, 'B2*2' FROM nation")
def scan_xlsx(spark, d):
    """A workbook for each nation; formulas aren't run, their stored values are read."""
    books = load(spark, d, "nation").select(F.col("n_name").alias("path"), readers.sample_workbook("n_name", F.col("n_nationkey")).alias("content"))
    return readers.read_xlsx(books).select("sheet", "row", F.col("column").alias("col"), "value", "formula")


@query("SELECT n_name AS sheet, 2 AS row, unnest([1, 28]) AS col, unnest([n_name, (n_nationkey * 2)::VARCHAR]) AS value FROM nation")
def xlsx_chart_cells(spark, d):
    """The cells of the range that each workbook's chart draws."""
    books = load(spark, d, "nation").select(F.col("n_name").alias("path"), readers.sample_workbook("n_name", F.col("n_nationkey")).alias("content"))
    return readers.read_chart_cells(books).select("sheet", "row", F.col("column").alias("col"), "value")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR regexp_matches(coalesce(text, ''), '[\\x{4e00}-\\x{9fff}]') THEN 'zh' ELSE 'en' END AS lang FROM documents")
def language_guess(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" 温"))).otherwise(F.coalesce("text", F.lit("")))
    return load(spark, d, "documents").select("doc_id", X.language_guess(text).alias("lang"))


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation")
def json_flatten_legacy(spark, d):
    """Objects of a list as rows, with the fields of inner objects under dotted names."""
    path = scratch(spark)
    record = F.struct("n_nationkey", F.struct("n_name", F.struct("n_regionkey").alias("in")).alias("at"))
    load(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(record).alias("rows")).select(F.to_json(F.struct("rows"))).write.text(path)
    flat = readers.flattened(readers.json_table(readers.read_jsonl(spark, path), "$.rows"), {"n_nationkey": "int", "at.n_name": "string", "at.in.n_regionkey": "int"})
    return flat.select(F.col("n_nationkey").alias("k"), F.col("`at.n_name`").alias("name"), F.col("`at.in.n_regionkey`").alias("region"))


@query("SELECT n_regionkey::VARCHAR AS folder, string_agg(n_name || '温', '' ORDER BY n_name) AS text FROM nation GROUP BY 1")
def scan_text(spark, d):
    """A text file for each region, read whole and decoded."""
    path = scratch(spark)
    load(spark, d, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name").select(F.col("n_regionkey").alias("folder"), F.concat("n_name", F.lit("温"))).write.partitionBy("folder").option("lineSep", "\u0001").text(path)
    return readers.read_text(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", "folder=([0-9]+)", 1).alias("folder"), F.replace("text", F.lit("\u0001"), F.lit("")).alias("text"))


@query("SELECT DISTINCT event_type || '-' || (event_id % 50) AS key FROM events")
def idempotent_enqueue(spark, d):
    """Tasks come in a stream, again and again; each key is queued once."""
    path, out = f"{d}/events.parquet", scratch(spark)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    tasks = rows.select(F.concat_ws("-", "event_type", F.col("event_id") % 50).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    new_tasks(tasks, "36500 days").select("key").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string").parquet(out)
