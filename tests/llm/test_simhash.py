import random

import numpy as np
from xxhash import xxh64_intdigest

from lodestone.llm import simhash


def plain(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    return sorted(((i, f - (1 << 64) if f >> 63 else f, min((k for (k, _), q in zip(rows, part, strict=True) if q == p and k is not None), default=None)) for (i, _), f, p in zip(rows, fps, part, strict=True)), key=str)


def test_components(corpus, documents):
    assert sorted((tuple(r) for r in simhash.simhash_components(documents).collect()), key=str) == brute(corpus)


def test_masks_cover_every_pair():
    masks = simhash.covering_masks()
    assert len(masks) == 49 and all(bin(m & (2**64 - 1)).count("1") >= 50 for m in masks)
    for a in range(64):
        for b in range(64):
            assert any(not (m >> a & 1 or m >> b & 1) for m in masks)


def test_chains_link(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {x for b in base for x in (b, b ^ 3, b ^ 3 ^ 12, b ^ 3 ^ 12 ^ 48)}
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(sorted(fps))]
    from lodestone.llm.shared import components

    found = components(simhash.bucket_edges(spark.createDataFrame(rows, "fp long, rep long")))
    assert found.count() == len(fps) and found.select("component").distinct().count() == 30


def test_deduplicated(documents, no_documents):
    kept = simhash.deduplicated(documents)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    ids = [i for i, _ in rows]
    assert kept.columns == documents.columns and len(rows) == len(set(rows))
    assert ids.count(5) == 2  # two rows with one id and different texts
    assert 4 in ids and 61 not in ids
    assert simhash.deduplicated(no_documents).collect() == [] and simhash.simhash_components(no_documents).collect() == []


def test_hubs_are_dealt(spark, monkeypatch):
    from lodestone.llm import shared

    monkeypatch.setattr(shared, "SMALL", 10)
    monkeypatch.setattr(shared, "HEAVY", 16)
    edges = [(500, i) for i in range(500)] + [(700 + i, 701 + i) for i in range(40)] + [(900, 0), (None, 3), (5, 5)]
    found = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(501)}, 900: 0, **{700 + i: 700 for i in range(41)}}
    rows, table = spark.createDataFrame([(i % 3 and 1, i) for i in range(100)], "k long, x long"), spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, s string")
    assert sorted(tuple(r) for r in shared.joined(rows, table, "k", "x").select("x", "s").collect()) == [(i, "b" if i % 3 else "a") for i in range(100)]
