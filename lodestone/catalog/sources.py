"""Queries over sources: texts in chunks, pages as records, nested JSON, sinks read back, the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, registry, sinks
from ..streaming.resample import resampled_stream
from .registry import load, query, scratch
from .timeseries import facts


CHUNK_SQL = """WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
    c(doc_id, place, start, stop) AS (SELECT doc_id, 0, 0, 0 FROM t WHERE n > 0 UNION ALL
        SELECT t.doc_id, c.place + 1, x.at, CASE WHEN x.at + 900 < n AND greatest(x.best, x.dot) > 450 THEN x.at + greatest(x.best, x.dot) + 1 ELSE least(n, x.at + 900) END FROM c JOIN t USING (doc_id),
            LATERAL (SELECT CASE WHEN c.place = 0 THEN 0 ELSE greatest(c.start + 1, c.stop - 100) END AS at, 900 AS w) y,
            LATERAL (SELECT y.at AS at, strpos(reverse(substr(t.t, y.at + 1, 900)), chr(10)) AS lb, strpos(reverse(substr(t.t, y.at + 1, 900)), '。') AS ld, least(900, n - y.at) AS m) z,
            LATERAL (SELECT z.at AS at, CASE WHEN z.lb > 0 THEN z.m - z.lb ELSE -1 END AS best, CASE WHEN z.ld > 0 THEN z.m - z.ld ELSE -1 END AS dot) x
        WHERE c.stop < n)
    SELECT doc_id, (place - 1)::INT AS place, start::INT AS start, stop::INT AS stop, sha256(substr(t, start + 1, stop - start)) AS sha256 FROM c JOIN t USING (doc_id) WHERE place > 0"""


@query(CHUNK_SQL)
def chunk_text(spark, d):
    return readers.chunked(load(spark, d, "documents"), "doc_id", "text").select("doc_id", "place", "start", "stop", F.sha2("chunk", 256).alias("sha256"))


PARAGRAPHS = """WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\n\\s*\\n'),
        lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda p: p <> '') AS p FROM documents),
    r(doc_id, i, now, done) AS (SELECT doc_id, 0, '', []::VARCHAR[] FROM s UNION ALL SELECT r.doc_id, r.i + 1,
        CASE WHEN length(now) + length(q) + 1 <= 700 THEN CASE WHEN now = '' THEN q ELSE now || chr(10) || q END WHEN length(q) <= 700 THEN q ELSE '' END,
        CASE WHEN length(now) + length(q) + 1 <= 700 THEN [] ELSE CASE WHEN now <> '' THEN [now] ELSE [] END || CASE WHEN length(q) <= 700 THEN [] ELSE list_transform(range(0, length(q), 620), lambda k: substr(q, k + 1, 700)) END END
        FROM r JOIN s USING (doc_id), LATERAL (SELECT p[r.i + 1] AS q) WHERE r.i < len(p)),
    e AS (SELECT doc_id, i, done FROM r UNION ALL SELECT doc_id, i + 1, [now] FROM r JOIN s USING (doc_id) WHERE i = len(p) AND now <> ''),
    u AS (SELECT doc_id, i, unnest(range(len(done))) AS k, unnest(done) AS chunk FROM e)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS place, sha256(chunk) AS sha256 FROM u"""


@query(PARAGRAPHS)
def chunk_paragraph_legacy(spark, d):
    return readers.paragraph_chunks(load(spark, d, "documents"), "doc_id", "text").select("doc_id", "place", F.sha2("chunk", 256).alias("sha256"))


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def scan_jsonl(spark, d):
    path = scratch(spark)
    load(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text"))).write.text(path)
    get = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind)
    return readers.read_jsonl(spark, path).select(get("conv_id", "bigint").alias("conv_id"), get("turn", "bigint").alias("turn"), get("role", "string").alias("role"), F.length(get("text", "string")).cast("long").alias("n"))


@query("SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars, 3::BIGINT AS n_tags FROM conversations GROUP BY conv_id")
def json_independent_tables(spark, d):
    records = load(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("turns")).select(F.parse_json(F.to_json(F.struct("conv_id", "turns", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("tags")))).alias("record"))
    keyed = records.withColumn("conv_id", F.try_variant_get("record", "$.conv_id", "bigint"))
    items = lambda p: keyed.select("conv_id", F.explode(F.try_variant_get("record", p, "array<variant>")).alias("x"))
    turns = items("$.turns").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length(F.try_variant_get("x", "$.text", "string"))).cast("long").alias("n_chars"))
    return turns.join(items("$.tags").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_tags")), "conv_id")


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def scan_csv(spark, d):
    path = scratch(spark)
    load(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").write.csv(path, header=True)
    rows = readers.numbers_inferred(readers.read_csv(spark, path))
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_retailprice")


@query("""SELECT ext AS extension, 'root' AS "table", count(*) AS n, sum(p_partkey)::BIGINT AS keys, count(p_name) AS n_names, sum(p_partkey % 2)::BIGINT AS n_broken, 0::BIGINT AS n_issues FROM part, (SELECT unnest(['csv', 'json']) AS ext) GROUP BY ext""")
def parser_registry(spark, d):
    """A folder with delimited and JSON-lines files, read by the parser of each extension; some names hold line breaks."""
    path = scratch(spark)
    name = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit('two "lines",\n'), "p_name")).otherwise(F.col("p_name"))
    p = load(spark, d, "part").select("p_partkey", name.alias("p_name"), "p_size")
    p.write.csv(f"{path}/a", header=True, escape='"', quoteAll=True)
    p.write.json(f"{path}/b/c")
    rows = registry.read_files(spark, path, registry.standard().register(["json"], registry.json_lines))
    v = F.col("values")
    return rows.groupBy("extension", "table").agg(F.count(F.lit(1)).alias("n"), F.sum(v["p_partkey"].cast("long")).alias("keys"), F.count(v["p_name"]).alias("n_names"), F.count_if(v["p_name"].contains('"lines",\n')).alias("n_broken"), F.count("issue").alias("n_issues"))


@query("SELECT n_name AS series, 'v' AS field, count(*) AS n, round(sum(x), 6)::DOUBLE AS total FROM nation, LATERAL (SELECT unnest([1.5, 2.5, 4.0]) * n_nationkey AS x) GROUP BY n_name")
def scan_tsv_measurement(spark, d):
    k = F.col("n_nationkey")
    sample = lambda i, f: F.concat(F.lit(f"2024-01-0{i}T00:00:00Z\t"), (k * f).cast("string"))
    text = F.concat_ws("\n", F.lit("a description"), F.to_json(F.struct(F.col("n_name").alias("series_id"))), F.lit("timestamp\tv"), sample(1, 1.5), sample(2, 2.5), sample(3, 4.0))
    x = readers.measurements(load(spark, d, "nation").select(F.col("n_name").alias("path"), text.alias("text")))
    return x.groupBy("series", "field").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT 'f' || p_partkey || '.jpg' AS file, 2::BIGINT AS n, 'a ' || p_name || '|' || p_name AS captions FROM part")
def coco_captions(spark, d):
    """One captions file for each hundred parts; images and their captions may stand in different files."""
    k, path = F.col("p_partkey"), scratch(spark)
    p = load(spark, d, "part")
    images = p.groupBy(F.floor(k / 100).alias("f")).agg(F.collect_list(F.struct(k.alias("id"), F.concat(F.lit("dir/f"), k.cast("string"), F.lit(".jpg")).alias("file_name"))).alias("images"))
    notes = p.select(k, F.explode(F.array(F.col("p_name"), F.concat(F.lit("a "), "p_name"))).alias("c")).groupBy(F.floor((k + 30) / 100).alias("f")).agg(F.collect_list(F.struct(k.alias("image_id"), F.col("c").alias("caption"))).alias("annotations"))
    images.join(notes, "f", "full").select(F.to_json(F.struct("images", "annotations"))).write.text(path)
    return readers.captions(readers.read_jsonl(spark, path)).withColumn("captions", F.array_join("captions", "|"))


@query("SELECT p_partkey, p_size::VARCHAR AS lexeme FROM part")
def number_lexemes(spark, d):
    text = F.to_json(F.struct(F.struct(F.col("p_size").alias("a/b")).alias("x")))
    return load(spark, d, "part").select("p_partkey", readers.lexemes(text)["/x/a~1b"].alias("lexeme"))


@query("""SELECT n_nationkey AS k, round(CASE n_nationkey % 3 WHEN 0 THEN 6.0 * s * s WHEN 1 THEN 5.0 * s * s ELSE 3.0 * s * s END, 6)::DOUBLE AS area, CASE n_nationkey % 3 WHEN 0 THEN round(s * s * s, 6)::DOUBLE END AS volume,
    n_nationkey % 3 = 0 AS closed, n_nationkey % 3 = 0 AS oriented, false AS degenerate, CASE n_nationkey % 3 WHEN 0 THEN 0.333333::DOUBLE END AS first_moment, CASE n_nationkey % 3 WHEN 0 THEN 7.0::DOUBLE END AS area_ratio FROM nation, LATERAL (SELECT (n_nationkey + 1)::DOUBLE AS s)""")
def mesh_features(spark, d):
    """Cubes, cubes without a lid, and L-shaped faces, which a fan of triangles would get wrong."""
    k, s = F.col("n_nationkey"), (F.col("n_nationkey") + 1).cast("string")
    side = lambda v: F.lit("0") if v == 0 else s if v == 1 else (2 * (F.col("n_nationkey") + 1)).cast("string")
    vertex = lambda c: F.concat_ws(" ", F.lit("v"), *map(side, c))
    cube = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    bend = [(1, 1, 0), (2, 1, 0), (2, 0, 0), (0, 0, 0), (0, 2, 0), (1, 2, 0)]
    faces = "f 1 4 3 2\nf 1 2 6 5\nf 2 3 7 6\nf 3 4 8 7\nf 4 1 5 8"
    text = F.when(k % 3 == 0, F.concat_ws("\n", *map(vertex, cube), F.lit(faces + "\nf 5 6 7 8"))).when(k % 3 == 1, F.concat_ws("\n", *map(vertex, cube), F.lit(faces))).otherwise(F.concat_ws("\n", *map(vertex, bend), F.lit("f 1 6 5 4 3 2")))
    m = load(spark, d, "nation").select(k.alias("k"), readers.mesh_columns(text).alias("m"))
    form = lambda i: F.when(F.col("k") % 3 == 0, F.round(F.col("m.features")[i], 6))
    return m.select("k", F.round("m.area", 6).alias("area"), F.round("m.volume", 6).alias("volume"), "m.closed", "m.oriented", "m.degenerate", form(0).alias("first_moment"), form(3).alias("area_ratio"))


@query("SELECT n_nationkey AS k, n_name AS text, 10.0::DOUBLE + 2 * n_nationkey AS x, 5.0::DOUBLE AS y FROM nation")
def scan_svg(spark, d):
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(10,5) scale(2)"><text x="'), F.col("n_nationkey").cast("string"), F.lit('" y="0">'), F.col("n_name"), F.lit("</text></g></svg>"))
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.explode(readers.drawing_texts(svg)).alias("t")).select("k", "t.*")


@query("SELECT event_type AS metric, count(*) AS n, max(value) AS most FROM events GROUP BY 1")
def write_facts(spark, d):
    path = scratch(spark)
    sinks.write_facts(facts(spark, d), path)
    return spark.read.parquet(path).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


@query("SELECT n_regionkey::VARCHAR AS folder, sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS sha256, sum(strlen(n_name) + 1)::BIGINT AS size FROM nation GROUP BY 1")
def manifest(spark, d):
    """A text file of names for each region; its hash and size must be those of its lines."""
    path = scratch(spark)
    load(spark, d, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name").select(F.col("n_regionkey").alias("folder"), "n_name").write.partitionBy("folder").text(path)
    files = sinks.manifest(spark, path).where("path LIKE '%.txt'")
    return files.select(F.regexp_extract("path", "folder=([0-9]+)", 1).alias("folder"), "sha256", "size")


@query("""SELECT p_brand AS folder, CASE b % 5 WHEN 1 THEN 'SHA256_MISMATCH' WHEN 2 THEN 'SIZE_MISMATCH' WHEN 3 THEN 'MISSING' WHEN 4 THEN 'UNLISTED' ELSE 'OK' END AS status, CASE WHEN b % 5 = 0 THEN sum(strlen(p_name) + 1)::BIGINT END AS n_bytes
    FROM (SELECT *, string_split(p_brand, '#')[-1]::INT AS b FROM part) GROUP BY p_brand, b""")
def verified_objects(spark, d):
    """A file for each brand, listed and then changed: some in their letters, some in their size, some gone, some not listed."""
    path, p = scratch(spark), load(spark, d, "part")
    kind = F.substring_index("p_brand", "#", -1).cast("int") % 5
    lines = p.select(F.col("p_brand").alias("folder"), F.col("p_name").alias("value"), kind.alias("kind"))
    put = lambda rows, to: rows.repartition(8, "folder").select("folder", "value").write.partitionBy("folder").mode("append").text(f"{path}/{to}")
    put(lines, "before")
    folder = F.regexp_extract(F.url_decode("path"), "folder=([^/]+)", 1)
    listed = sinks.manifest(spark, f"{path}/before").select(F.concat(F.lit("/"), folder).alias("path"), "sha256", "size")
    listed = listed.where(F.substring_index("path", "#", -1).cast("int") % 5 != 4)
    put(lines.where("kind <> 3").withColumn("value", F.when(F.col("kind") == 1, F.reverse("value")).when(F.col("kind") == 2, F.concat("value", F.lit("!"))).otherwise(F.col("value"))), "after")
    found = sinks.verified(spark, f"{path}/after", listed, folder=F.concat(F.lit("/"), folder))
    return found.select(F.substring("path", 2, 100).alias("folder"), "status", F.octet_length("content").cast("long").alias("n_bytes"))


@query("SELECT CASE page_id % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'table' WHEN 2 THEN 'geometry' WHEN 3 THEN 'json' WHEN 4 THEN 'text' ELSE 'other' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def asset_kinds(spark, d):
    names = F.array(*[F.lit(x) for x in ("/a.PNG", "/b.xlsx", "/c.stp", "/d.JSON", "/e.pdf", "/f.html")])
    path = F.concat(F.lit("/data"), F.element_at(names, (F.col("page_id") % 6 + 1).cast("int")))
    return load(spark, d, "pages").groupBy(readers.format_of(path).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS entity, event_type AS metric, date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS n, max(value) AS max_value FROM events GROUP BY ALL")
def stream_resample(spark, d):
    """The stream over the table's files, run to its end; each batch replaces the windows that it changed.

    Update mode gives a window again whenever it has grown, so only the newest version of each is kept when reading."""
    path = f"{d}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    rows = source.select(F.col("user_id").alias("entity"), F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value")
    totals, out = resampled_stream(rows, late="36500 days"), scratch(spark)
    spark.createDataFrame([], totals.schema.add("batch", "long")).write.parquet(out)  # what a stream without a batch leaves
    run = totals.writeStream.foreachBatch(lambda part, i: part.withColumn("batch", F.lit(i).cast("long")).write.mode("append").parquet(out)).outputMode("update")
    run.trigger(availableNow=True).option("checkpointLocation", scratch(spark)).start().awaitTermination()
    newest = lambda c: F.max_by(c, "batch").alias(c)
    found = spark.read.parquet(out).groupBy("entity", "metric", "bucket").agg(newest("n"), newest("max_value"))
    return found.select("entity", "metric", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n", "max_value")


