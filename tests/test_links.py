"""Product links over tiers, conditions inside a binding, headings over words, results kept by content: against plain versions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.functions.predicates import Condition
from lodestone.operators import relations as R
from lodestone.operators import snapshot as N
from lodestone.streaming import derived


def plain_links(entities):
    known = {e[0] for e in entities}
    products = {i for i, key, f in entities if key == "sku_id" and i in f.get("sku_id", [])}
    links = {i: {x for n in ("sku_id", "sku_ids_json") for x in f.get(n, [])} & products for i, _, f in entities}
    for _, _, f in entities:
        if f.get("bom_id"):
            for part in f.get("part_id", []):
                for i, key, _ in entities:
                    if i == part and key == "part_id":
                        links[i] |= set(f.get("sku_id", [])) & products
    refs = {}
    for i, _, f in entities:
        if not links[i]:
            targets = [({x for n in t for x in f.get(n, [])} & known) - {i} for t in R.TIERS]
            refs[i] = next((t for t in targets if t), set())
    while True:
        more = {i: set().union(*(links[t] for t in ts)) - links[i] for i, ts in refs.items()}
        if not any(more.values()):
            return sorted((i, p) for i, ps in links.items() for p in ps)
        for i, ps in more.items():
            links[i] |= ps


def test_tiers_cycles_and_bills(spark):
    rng = random.Random(6)
    for turn in range(4):
        ids = [f"e{i}" for i in range(60)]
        entities = [(f"s{i}", "sku_id", {"sku_id": [f"s{i}"]}) for i in range(5)] + [("s9", "sku_id", {"sku_id": ["other"]})]
        for i in ids:
            f = {}
            for t in rng.sample(R.TIERS, rng.randint(0, 3)):
                f[rng.choice(t)] = [rng.choice([*ids, i, "nowhere", ""]) for _ in range(rng.randint(1, 2))]
            if rng.random() < 0.12:
                f["sku_id"] = [rng.choice(["s0", "s1", "s2", "s9"])]
            entities.append((i, rng.choice(["part_id", "batch_id"]), f))
        df = spark.createDataFrame(entities, "entity_id string, primary_key string, fields map<string,array<string>>").repartition(3)
        assert sorted(tuple(r) for r in R.product_links(df).collect()) == plain_links(entities), turn


def test_the_first_known_tier_holds(spark):
    rows = [("s", "sku_id", {"sku_id": ["s"]}), ("bom", "bom_id", {"bom_id": ["bom"], "part_id": ["p"], "sku_id": ["s"]}), ("p", "part_id", {}), ("q", "part_id", {}), ("x", "b", {"part_id": ["q"], "bom_id": ["bom"]}), ("y", "b", {"part_id": ["gone"], "bom_id": ["bom"]})]
    got = R.product_links(spark.createDataFrame(rows, "entity_id string, primary_key string, fields map<string,array<string>>")).collect()
    assert sorted(r["entity_id"] for r in got) == ["bom", "p", "s", "y"]  # x's part is known, and has no product


def test_chains_stay_inside_a_binding(spark):
    at = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc)
    bindings = [("one", x) for x in ("o1", "l1", "p1", "o2")] + [("two", x) for x in ("o1", "p2", "o3")] + [("three", x) for x in ("o4", "p1")]
    references = [("o1", "l1"), ("l1", "p1"), ("o1", "m"), ("m", "p2"), ("o2", "o1"), ("p1", "o4"), ("o3", "o3")]
    records = [("o1", {"event.made": at(5)}, "a"), ("o2", {"event.made": at(9)}, "a"), ("o3", {"event.made": at(5)}, "b"), ("o4", {"event.made": at(5)}, "a"), ("p1", {"event.made": at(5)}, "a"), ("loose", {"event.made": at(5)}, "a")]
    keys = [(x, {"o": "order_id", "l": "line_id", "p": "part_id"}[x[0]]) for x in ("o1", "o2", "o3", "o4", "l1", "p1", "p2")]
    df = lambda rows, shape: spark.createDataFrame(rows, shape)
    tables = df(bindings, "binding string, entity_id string"), df(references, "source string, target string"), df(records, "record_id string, dates map<string,timestamp>, stage string"), df(keys, "entity_id string, primary_key string")
    found = lambda anchors, dates, **more: sorted(tuple(r) for r in N.bound_records(*tables, anchors, dates, **more).collect())
    early = [Condition("event.made", "lt", "2024-01-07")]
    assert found([Condition("part_id", "in", ["p1", "p2"])], early) == [("one", "o1"), ("one", "p1"), ("three", "o4"), ("three", "p1")]
    assert found([Condition("part_id", "eq", "p2")], early) == []  # the chain to p2 leaves the binding
    assert found([Condition("order_id", "eq", "o1")], []) == [("one", "o1"), ("one", "p1"), ("two", "o1")]  # o2 is another order
    assert found([Condition("part_id", "eq", "p1"), Condition("order_id", "eq", "o4")], early) == [("three", "o4"), ("three", "p1")]
    assert found([], early, stages=["b"]) == [("two", "o3")]
    links = df([("o3", "s1"), ("o1", "s2")], "entity_id string, product string")
    assert found([Condition("sku_id", "in", ["s1", "s7"])], early, products=links) == [("two", "o3")]


def plain_columns(words):
    out = []
    for page, _, i, x0, y0, y1, _ in words:
        lines = {}
        for w in words:
            if w[0] == page:
                lines.setdefault(w[1], []).append(w)
        good = [(max(w[5] for w in ws), b) for b, ws in lines.items() if len({round(w[3], 1) for w in ws}) >= 2]
        good = [(y, b) for y, b in good if y < y0] if 0 < y1 - y0 <= 64 else []
        header = None
        if good:
            top = max(y for y, _ in good)
            block = min(b for y, b in good if y == top)
            names = [w[6] for w in lines[block] if abs(w[3] - x0) <= 1.5]
            header = names[0] if len(names) == 1 else None
        out.append((page, i, header))
    return sorted(out)


def test_headings_of_words(spark):
    rng = random.Random(1)
    words = []
    for page in range(6):
        for block in range(12):
            y, tall = rng.randint(0, 40) * 10.0, rng.choice([8.0, 8.0, 10.0, 70.0])
            for k in range(rng.randint(1, 4)):
                skew = rng.choice([0.0, 0.25, 1.0])
                words.append((page, block, len(words), k * rng.choice([1.0, 50.0]) + rng.choice([0.0, 0.5, 1.5, 2.0]), y + skew, y + tall + skew, f"h{block}-{k}"))
    df = spark.createDataFrame(words, "page int, block int, id long, x0 double, y0 double, y1 double, text string").repartition(4)
    got = sorted(tuple(r) for r in R.band_columns(df).collect())
    assert got == plain_columns(words) and sum(r[2] is not None for r in got) > 40


def test_a_second_run_reads_and_parses_nothing(spark, tmp_path):
    files, store = str(tmp_path / "in"), str(tmp_path / "store")
    put = lambda rows: spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(files)
    parse = lambda new: new.select("sha", F.length("content").alias("n"))
    run = lambda v="1": derived.refreshed(spark, files, store, v, parse)
    put([("a", "xx"), ("b", "xx"), ("c", "yyy"), ("d", None)])
    assert run() == {"rows": 4, "parsed": 3}
    assert run() == {"rows": 0, "parsed": 0}
    put([("e", "xx"), ("f", "zzzz")])
    assert run() == {"rows": 2, "parsed": 1}
    assert sorted(r["n"] for r in derived.held(spark, store, "1").where("n is not null").collect()) == [2, 3, 4]
    assert derived.held(spark, store, "1", what="names").count() == 6
    assert run("2") == {"rows": 6, "parsed": 4} and derived.held(spark, store, "3") is None


def test_paths_are_doubled(spark):
    """A chain of 600 edges took 600 rounds; every source is a start here, so ten are enough."""
    edges = spark.range(600).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    from lodestone.operators import relations

    found = relations.reachable(edges, spark.range(601).select(F.col("id").alias("start")), max_rounds=11)
    assert found.count() == found.distinct().count() == 601 * 602 // 2


def test_doubled_paths_with_circles(spark):
    import random

    from lodestone.operators import relations

    rng = random.Random(3)
    pairs = [(rng.randint(0, 40), rng.randint(0, 60)) for _ in range(70)] + [(i, i + 1) for i in range(80, 100)] + [(100, 80), (7, 7)]
    to: dict = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)

    def plain(start):
        seen, waiting = {start}, [start]
        while waiting:
            for b in to.get(waiting.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    waiting.append(b)
        return {(start, b) for b in seen}

    starts = [*to, 500]
    edges = spark.createDataFrame([*pairs, (None, 1), (2, None)], "source long, target long")
    for chosen in (starts, starts[::3]):  # doubled, and round by round
        found = [tuple(r) for r in relations.reachable(edges, spark.createDataFrame([(i,) for i in chosen], "start long")).collect()]
        assert len(found) == len(set(found)) and set(found) == set().union(*map(plain, chosen))


def test_headings_are_found_without_distinct_counts(spark):
    """Words outside blocks, nearly all, went through a count of distinct places and were copied for three buckets each."""
    words = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 8.0, "a"), (1, 0, 2, 100.0, 0.0, 8.0, "b"), (1, None, 3, 100.9, 20.0, 28.0, "x"), (1, None, 4, 98.6, 20.0, 28.0, "y"), (1, None, 5, 50.0, 20.0, 28.0, "z")], "page long, block long, id long, x0 double, y0 double, y1 double, text string")
    found = R.band_columns(words)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "distinct" not in plan.lower() and {r["id"]: r["header"] for r in found.collect()} == {1: None, 2: None, 3: "b", 4: "b", 5: None}
