"""The registered query of each operator, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embedding_dedup, html_text, mixing, packing, periodic_runs, pieces, quality_model, quality_rules, simhash, substring_dedup, suffix_dedup
from .shared import table

#: The SentencePiece model of the registered queries.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), MODEL).withColumnRenamed("id", "doc_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.counted(table(spark, sf_dir, "documents"), MODEL).withColumnRenamed("id", "doc_id")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.linked(table(spark, sf_dir, "embeddings"))
    own = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), own.alias("kept"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), keep=("doc_id",))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *[F.col(f"_{x}").alias(x) for x in names])


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op11: those of about a tenth of the documents repeat from a place on with a period that their id gives."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detected(table(spark, sf_dir, "documents"), edit=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    start, length, period = (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period")
    exponent = F.expr("1000 * best.length div -best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", start, length, period, exponent, F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM t WHERE len(w) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS c FROM p),
c AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM g, (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT t.doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(r, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN c ON t.doc_id = c.doc_id),
f AS (SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2, n_symbols > 0.1::DOUBLE * n_words AS f3,
    n_dup_lines > 0.3::DOUBLE * n_lines AS f4, (word_chars / greatest(n_words, 1)) NOT BETWEEN 2.5 AND 12 AS f5 FROM m),
u AS (SELECT doc_id, host, rule, failed FROM f, LATERAL (SELECT unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS failed)),
h AS (SELECT host, rule, count(*) AS n, sum(failed::INT)::DOUBLE AS k FROM u GROUP BY host, rule),
q AS (SELECT rule, sum(k) / sum(n) AS mean, var_pop(k / n) AS v FROM h GROUP BY rule),
s AS (SELECT rule, mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, 1), 1000) ELSE 1000 END AS strength FROM q),
b AS (SELECT doc_id, bool_or(failed AND (k + strength * mean) / (n + strength) > 0.02) AS habit
    FROM u JOIN h USING (host, rule) JOIN s USING (rule) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND NOT habit AS kept
FROM f JOIN b USING (doc_id)
"""


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON vec_id = k.x LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON vec_id = m.x
"""


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT s.lang, s.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) t ON s.lang = t.lang AND s.source = t.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p
    FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v) AS q FROM (SELECT lang, term, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, (p.p - r.p) * (p.p - r.p) // r.p AS f
    FROM p JOIN p r USING (lang, term), LATERAL (SELECT p.lang, p.source) a, LATERAL (SELECT r.source) b WHERE p.source <> r.source),
s AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT lang, source, item, sum(f) AS value FROM pairs GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM s UNION ALL FROM t))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
x AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS y
    FROM s WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(y) OVER () AS level FROM x),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, level * w) AS target, floor(least((3 * source_size)::DOUBLE, level * w) + 0.5)::BIGINT AS tokens FROM l),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || size), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d WHERE size > 0)
SELECT d.doc_id, d.size, source_size, target, 0::BIGINT AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size = 0
UNION ALL SELECT doc_id, size, source_size, target, (tokens // source_size * size + greatest(0, least(a + size, tokens % source_size) - a))::BIGINT
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_suffix_array_dedup, op3_substring_dedup, op4_html_extraction, op5_sentencepiece, op6_token_counts, op7_embedding_near_dedup, op8_quality_classifier, op9_quality_rules, op10_simhash_near_dedup, op11_periodic_runs, op12_source_divergence, op13_source_mixing)}


def oracle_sql() -> dict:
    return {"op7_embedding_near_dedup": OP7_SQL, "op9_quality_rules": OP9_SQL, "op12_source_divergence": OP12_SQL, "op13_source_mixing": OP13_SQL}
