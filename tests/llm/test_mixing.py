import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing as M
from lodestone.llm import queries


@pytest.fixture(scope="module")
def mixed_docs(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 90))), rng.choice(["big"] * 30 + ["é", "a", "B", "z", None, ""])) for i in range(900)]
    rows += [(i, "w " * n, s) for i, n, s in [(1000, 9000, "big"), (1001, 1, "lone"), (1002, 0, "empty"), (1003, 0, "big"), (1004, 700, "one")]]
    rows += [(5, "w w w", "big")] * 3 + [(None, "w w", "a")] * 2 + [(None, None, None), (7, None, "none")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, bucket int, key string").repartition(4)
    at = str(tmp_path_factory.mktemp("mixing"))
    df.write.parquet(f"{at}/documents.parquet")
    return at, df, rows


def plain_targets(sizes, weights=(5, 2, 1)):
    """Shares given again and again until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] / w > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        full |= over


def test_contract(spark, mixed_docs):
    at, _, rows = mixed_docs
    out = queries.op13_source_mixing(spark, at).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    sizes, taken, source = Counter(), Counter(), {i: s for i, t, s in rows}
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    for r in out:
        if r["doc_id"] is None:
            s = "a" if r["size"] else None
        else:
            s = source[r["doc_id"]] if r["doc_id"] != 5 or r["size"] != 3 else "big"
            if r["doc_id"] in (5, 7) and r["source_size"] != sizes[s]:
                s = next(x for i, t, x in rows if i == r["doc_id"] and sizes[x] == r["source_size"])
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert {s: taken[s] for s in sizes} == {s: int(want[s] + 0.5) for s in sizes}
    assert sorted(map(tuple, queries.op13_source_mixing(spark, at).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_against_sql(spark, mixed_docs):
    at, _, _ = mixed_docs
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{at}/documents.parquet/*.parquet'")
    want = db.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.OP13_SQL})").fetchall()
    assert sorted(map(tuple, queries.op13_source_mixing(spark, at).collect()), key=str) == sorted(want, key=str)


def test_any_stretch_is_mixed(mixed_docs):
    _, df, _ = mixed_docs
    m = M.mixed(df, mix=M.Mix(block=16, rows=50, chunk=64))
    plan = {r["key"]: r for r in m.plan.collect()}
    slots = sorted((r["slot"], r["key"], r["block"], r["epoch"], r["begin"], r["end"]) for r in m.slots.collect())
    n = sum(p["slots"] for p in plan.values())
    assert len({s[0] for s in slots}) == len(slots) == n
    turn = defaultdict(int)
    for _, key, block, epoch, begin, end in slots:  # each source's blocks come in order, whole but for the last
        p, r = plan[key], turn[key]
        assert (epoch, block) == divmod(r, p["blocks"]) and begin == block * p["length"] and begin < end
        turn[key] += 1
    for part in (0.25, 0.5, 0.8):
        for key, p in plan.items():
            got = sum(s[1] == key for s in slots[: int(part * n)])
            assert abs(got - part * p["slots"]) <= 14
    spans = defaultdict(list)
    for r in m.parts.collect():
        spans[r["slot"]].append((r["from"] + r["start"], r["n_tokens"]))
    for slot, _, _, _, begin, end in slots:  # what a slot takes of documents is its block, without gaps
        at = begin
        for start, size in sorted(spans[slot]):
            assert start == at
            at += size
        assert at == end


def test_reversed_bits(spark):
    got = spark.range(1024).select("id", M.reversed_bits(F.col("id"), 10).alias("r")).collect()
    assert all(r["r"] == int(f"{r['id']:010b}"[::-1], 2) for r in got)
    big = spark.range(1).select(M.reversed_bits(F.lit((1 << 39) + 5), 40).alias("r")).first()["r"]
    assert big == int(f"{(1 << 39) + 5:040b}"[::-1], 2)


def test_no_rows(spark, no_documents):
    assert M.taken(no_documents).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, M.taken(blank).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_no_python(mixed_docs):
    at, df, _ = mixed_docs
    m = M.mixed(df)
    for x in (m.rows, m.plan, m.slots, m.parts, M.taken(df)):
        plan = x._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
