"""Joins over entities, versions and edges."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


MERGED = 8  # rounds of a closure that are written as one


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local session, as in tests, gets a temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def catalog_row(entries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Entries with the number of rows that they name; only one match is a match, none and several are issues."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("matches"))
    found = entries.join(n, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    return found.withColumn("issue", F.when(F.col("matches") == 0, "ROW_NOT_FOUND").when(F.col("matches") > 1, "ROW_AMBIGUOUS"))


def verified_edges(edges: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Edges (source, target) both of whose ends exist."""
    known = entities.select(F.col(entity)).distinct()
    return edges.join(known.withColumnRenamed(entity, "source"), "source", "left_semi").join(known.withColumnRenamed(entity, "target"), "target", "left_semi")


def closure(edges: DataFrame, seeds: DataFrame, by: tuple[str, ...] = (), max_rounds: int = 10_000) -> DataFrame:
    """(by, start, node): what seeds (by, start, node) reach over edges (by, source, target), seeds included.

    With columns by, an edge is open only to seeds with the same values. Semi-naive: a round joins what the round before
    has found for the first time, and what is found is a union of checkpointed rounds, so plans stay short and each pair
    is joined once. Edges are made once for all rounds, and of rounds as many as MERGED are written again as one. Null
    ends lead nowhere."""
    checkpoint_dir(edges.sparkSession)
    pair = [*by, "start", "node"]
    new = seeds.select(*pair).where("node is not null").distinct().checkpoint()
    held = [(0, new)]
    way = edges.select(*by, F.col("source").alias("node"), "target").where("node is not null and target is not null").distinct().checkpoint()
    for _ in range(max_rounds):
        found = _union([x for _, x in held])
        step = new.join(way.hint("merge"), [*by, "node"]).select(*by, "start", F.col("target").alias("node")).distinct()
        new = step.join(found.hint("merge"), pair, "left_anti").checkpoint()
        if new.isEmpty():
            return found
        held.append((0, new))
        while len(same := [x for level, x in held if level == held[-1][0]]) == MERGED:
            held = [*held[:-MERGED], (held[-1][0] + 1, _union(same).checkpoint())]
    raise RuntimeError(f"the closure needs more than {max_rounds} rounds")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(start, node) for every node that edges (source, target) lead to from a start, which is reachable itself.

    Where every source is a start, all that is found starts somewhere too, and paths are doubled: a round joins the pairs
    whose shortest path is the longest so far with all pairs, so that paths of n edges take log2(n) rounds."""
    checkpoint_dir(edges.sparkSession)
    way = edges.select("source", "target").where("source is not null and target is not null").distinct().checkpoint()
    first = starts.select("start").where("start is not null").distinct().checkpoint()
    if not way.join(first, way["source"] == first["start"], "left_anti").isEmpty():
        return closure(way, first.select("start", F.col("start").alias("node")), max_rounds=max_rounds)
    none = first.select("start", F.col("start").alias("node"), F.lit(0).alias("n"))
    known = [none, way.where("source <> target").select(F.col("source").alias("start"), F.col("target").alias("node"), F.lit(1).alias("n"))]
    length = 1
    for _ in range(max_rounds):
        every = _union(known)
        last = every.where(F.col("n") == length).select("start", F.col("node").alias("via"))
        on = every.where("n > 0").select(F.col("start").alias("via"), "node", "n")
        step = last.join(on.hint("merge"), "via").groupBy("start", "node").agg((F.min("n") + length).alias("n"))
        new = step.join(every.select("start", "node").hint("merge"), ["start", "node"], "left_anti").checkpoint()
        if new.isEmpty():
            return every.select("start", "node")
        known.append(new)
        length *= 2
    raise RuntimeError(f"the closure needs more than {max_rounds} rounds")


# The key of products, the fields that name products, those of a bill of materials, and the foreign keys
# through which other records belong to products, by tiers: the first tier with a known target holds.
PRODUCT, PRODUCT_FIELDS, BOM = "sku_id", ("sku_id", "sku_ids_json"), ("bom_id", "part_id")
TIERS = (
    ("part_id", "part_ids_json"), ("bom_id", "bom_version_id"), ("finished_batch_id", "manufacturing_batch_id"), ("assembly_work_order_id", "work_order_id"),
    ("supplier_batch_id", "supplier_batch_ids_json"), ("purchase_line_id", "order_line_id", "sales_line_id"), ("serial_id",), ("qc_id", "inspection_id"),
)


def product_links(entities: DataFrame, tiers: tuple[tuple[str, ...], ...] = TIERS) -> DataFrame:
    """(entity_id, product): the products that each entity belongs to.

    entities has entity_id, primary_key (the field that is its key) and fields, a map of lists of text. An entity names
    products itself, or is a part that a bill of materials puts in one. Any other takes the products of the entities that
    its foreign keys name: of its tiers, the first that names a known entity other than itself holds, also if that one
    has no product, and those after it don't count. Products travel along these references round by round, through
    cycles too."""
    facts = entities.select("entity_id", F.explode("fields").alias("field", "values")).select("entity_id", "field", F.explode("values").alias("value")).where("value <> ''")
    products = entities.where((F.col("primary_key") == PRODUCT) & F.array_contains(F.col("fields")[PRODUCT], F.col("entity_id"))).select(F.col("entity_id").alias("value")).distinct()
    named = facts.where(F.col("field").isin(*PRODUCT_FIELDS)).join(products, "value", "left_semi").select("entity_id", F.col("value").alias("product"))
    bom, part = BOM
    listed = facts.where(F.col("field") == bom).select("entity_id").distinct()
    used = facts.where(F.col("field") == part).join(listed, "entity_id", "left_semi").select("entity_id", F.col("value").alias("part"))
    sold = facts.where(F.col("field") == PRODUCT).join(products, "value", "left_semi").select("entity_id", F.col("value").alias("product"))
    parts = entities.where(F.col("primary_key") == part).select(F.col("entity_id").alias("part")).distinct()
    usage = used.join(sold, "entity_id").join(parts, "part", "left_semi").select(F.col("part").alias("entity_id"), "product")
    checkpoint_dir(entities.sparkSession)
    own = named.unionByName(usage).distinct().checkpoint()
    tier = F.create_map(*[F.lit(x) for i, names in enumerate(tiers) for n in names for x in (n, i)])[F.col("field")]
    known = entities.select(F.col("entity_id").alias("value")).distinct()
    keys = facts.withColumn("tier", tier).where("tier is not null and value <> entity_id").join(known, "value", "left_semi").join(own, "entity_id", "left_anti")
    first = keys.groupBy("entity_id").agg(F.min("tier").alias("tier"))
    references = keys.join(first, ["entity_id", "tier"]).select(F.col("value").alias("source"), F.col("entity_id").alias("target"))
    found = closure(references, own.select(F.col("product").alias("start"), F.col("entity_id").alias("node")))
    return found.select(F.col("node").alias("entity_id"), F.col("start").alias("product"))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new put in or replaced; inserted tells which are new keys."""
    known = old.select(*key).distinct().withColumn("_known", F.lit(True))
    rows = new.join(known, key, "left").withColumn("inserted", F.col("_known").isNull()).drop("_known")
    return old.join(new.select(*key), key, "left_anti").withColumn("inserted", F.lit(False)).unionByName(rows)


def inserted_if_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old, key, "left_anti"))


def overlaid(parent: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A parent's file list with changes (key, action add, replace or remove, and the parent's columns)."""
    kept = parent.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where("action <> 'remove'").drop("action"))


def same_key(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """Keys that occur once in every source, and whether all values agree."""
    out = None
    for i, s in enumerate(sources):
        once = s.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias(f"v{i}")).where("_n = 1").drop("_n")
        out = once if out is None else out.join(once, key)
    names = [f"v{i}" for i in range(len(sources))]
    agree = F.lit(True)
    for n in names[1:]:
        agree = agree & (F.col(names[0]) == F.col(n))
    return out.withColumn("agree", agree)


def band_join(boxes: DataFrame, width: float = 1.5, tallest: float = 64.0) -> DataFrame:
    """Pairs (a, b) on one page whose top and bottom edges differ by width at most; taller boxes join with nothing.

    Rows meet in buckets of the top edge: each goes to its own and looks into its neighbours, so a page isn't crossed."""
    boxes = boxes.where(F.col("y1") - F.col("y0") <= tallest)
    bucket = F.floor(F.col("y0") / width)
    left = boxes.select("page", F.col("id").alias("a"), F.col("y0").alias("a0"), F.col("y1").alias("a1"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"))
    right = boxes.select("page", F.col("id").alias("b"), F.col("y0").alias("b0"), F.col("y1").alias("b1"), bucket.alias("bucket"))
    return left.join(right, ["page", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("a0") - F.col("b0")) <= width) & (F.abs(F.col("a1") - F.col("b1")) <= width)).select("page", "a", "b")


def band_columns(words: DataFrame, width: float = 1.5, tallest: float = 64.0) -> DataFrame:
    """(page, id, header): the heading of each word of a page's rows that stands under exactly one, or null.

    words has page, block, id, x0, y0, y1 and text. A block with words at two places or more (to a tenth) can be a line of
    headings. A word belongs to the lowest such block that ends above its own top, of equal ones the first, and to the
    heading in it whose left edge is within width of its own; one under several headings, or that is taller than tallest,
    has none. Blocks and words of a page are put in order of height, so that none meets all others; headings, fewer
    than words, are met in buckets of the left edge and of its neighbours."""
    place = F.round("x0", 1)
    lines = words.where("block is not null").groupBy("page", "block").agg(F.max("y1").alias("y"), (F.min(place) < F.max(place)).alias("several")).where("several").select("page", "y", "block")
    tops = lines.groupBy("page", "y").agg(F.min("block").alias("head"))
    marks = tops.select("page", "y", F.lit(0).alias("kind"), "head", F.lit(None).cast(words.schema["id"].dataType).alias("id"), F.lit(None).cast("double").alias("x0"))
    rows = words.where((F.col("y1") > F.col("y0")) & (F.col("y1") - F.col("y0") <= tallest)).select("page", F.col("y0").alias("y"), F.lit(-1).alias("kind"), F.lit(None).cast(words.schema["block"].dataType).alias("head"), "id", F.col("x0").cast("double"))
    above = Window.partitionBy("page").orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, -1)  # a block that ends at a word's top isn't above it
    placed = marks.unionByName(rows).withColumn("head", F.last("head", ignorenulls=True).over(above)).where("kind = -1 and head is not null")
    bucket = F.floor(F.col("x0") / width)
    asked = placed.select("page", "head", "id", "x0", bucket.alias("bucket"))
    heads = words.where("block is not null").select("page", F.col("block").alias("head"), F.col("x0").alias("h0"), F.col("text").alias("header"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket")).join(lines.select("page", F.col("block").alias("head")), ["page", "head"], "left_semi")
    under = asked.join(heads, ["page", "head", "bucket"]).where(F.abs(F.col("x0") - F.col("h0")) <= width)
    one = under.groupBy("page", "id").agg(F.count(F.lit(1)).alias("n"), F.min("header").alias("header")).where("n = 1").drop("n")
    return words.select("page", "id").join(one, ["page", "id"], "left")


def page(rows: DataFrame, order: list[str], mark: Column, size: int) -> DataFrame:
    """The first size rows in an order, with in_page, has_more and next_row, the mark of the first row after them."""
    top = rows.withColumn("_mark", mark).orderBy(*order).limit(size + 1)
    w = Window.orderBy(*order)  # over size + 1 rows
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = top.withColumns({"_r": F.row_number().over(w), "_n": F.count(F.lit(1)).over(every), "next_row": F.nth_value("_mark", size + 1).over(every)})
    return x.where(F.col("_r") <= size).withColumns({"in_page": F.lit(True), "has_more": F.col("_n") > size}).drop("_r", "_n", "_mark")
