import random

import pytest

from lodestone.llm import shared, simhash


def plain(edges):
    part = {}

    def root(x):
        part.setdefault(x, x)
        while part[x] != x:
            x = part[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = root(u), root(v)
            part[max(a, b)] = min(a, b)
    return {x: root(x) for x in part}


def cases():
    rng = random.Random(1)
    yield []
    yield [(None, 3), (5, 5)]
    yield [(2**63 - 1, -(2**63)), (0, 2**63 - 1)]
    yield [(i, i + 1) for i in range(900)]
    yield [(9000, i) for i in range(900)] + [(9000, 9001), (9001, 9002)] + [(-i, i * i + 10_000) for i in range(200)]
    yield [(rng.randrange(2000), rng.randrange(2000)) for _ in range(1300)]


@pytest.fixture
def jobs(spark):
    """Runs f and returns its result with the number of Spark jobs it took."""

    def run(f):
        name = f"components-{random.random()}"
        spark.sparkContext.setJobGroup(name, "")
        try:
            return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    return run


@pytest.mark.parametrize("rest", [1 << 18, 0])
def test_components_match_plain_ones(spark, rest, monkeypatch):
    monkeypatch.setattr(shared, "REST", rest)
    monkeypatch.setattr(shared, "CHUNK", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for edges in cases():
            got = [tuple(r) for r in shared.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()]
            assert len(got) == len(dict(got)) and dict(got) == plain(edges)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges_left_raise(spark, monkeypatch):
    monkeypatch.setattr(shared, "CHUNK", 2)
    with pytest.raises(RuntimeError):
        shared.components(spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long").repartition(3), max_rounds=1)


def test_a_chain_takes_few_jobs(spark, jobs):
    edges = [(i, i + 1) for i in range(2000)]
    found, n = jobs(lambda: shared.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect())
    assert len(found) == 2001 and {r["component"] for r in found} == {0} and n <= 20


def test_near_copies_take_few_jobs(spark, jobs):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(500)}" for _ in range(80)] for _ in range(40)]
    texts = [" ".join([*b, *[f"x{k}"] * (k > 0)]) for b in base for k in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept, n = jobs(lambda: simhash.deduplicated(docs).collect())
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 160, 4)) and n <= 90
