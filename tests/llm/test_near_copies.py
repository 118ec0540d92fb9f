import random
from itertools import combinations

import corpus_pipeline as C

import numpy as np
import pytest

from lodestone.llm import near_copies, simhash


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets, part = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if 5 * len(a & b) >= 4 * len(a | b):
            old, new = part[j], part[i]
            part = [new if p == old else p for p in part]
    return sorted((i, min(k for (k, _), q in zip(rows, part, strict=True) if q == p)) for (i, _), p in zip(rows, part, strict=True))


def planted():
    """Texts with one to many changed words each, a common passage, a group of near copies, short and empty texts."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage, texts = prose(rng, 60, words), []
    for k in range(40):
        base = prose(rng, rng.randint(5, 250), words).split()
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"new{k}"
            texts.append(" ".join(copy))
        texts.append(passage + " " + prose(rng, rng.randint(0, 25), words))
    base = prose(rng, 200, words).split()
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(200)] = f"other{k}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "", None, "one two", "One  two", "one two three", "x " * 50, "x " * 60]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("block", [256, 7])
def test_components_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rows = planted()
    want = brute(rows)
    found = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert 80 < len({c for _, c in want}) < len(rows) - 80


def test_stage_keeps_one_of_near_copies(spark):
    rows = planted()
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    stage = next(s for _, s in C.STAGES if s.__name__ == "near_dedup")
    kept = stage(spark, docs, "")
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(None) == 1
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in brute(rows)})
    assert stage(spark, docs.limit(0), "").collect() == []


def test_half_masks_cover(spark):
    masks, rng = simhash.half_masks(), random.Random(3)
    assert len(masks) == 126 and all(bin(m).count("1") in (16, 32) for m in masks)
    for _ in range(3000):
        bits = sum(1 << i for i in rng.sample(range(64), 11))
        assert any(not m & bits for m in masks)


def test_every_pair_in_the_radius_is_a_candidate(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(200)]
    fps = [x for b in base for x in (b, b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 11))))]
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    edges = {tuple(sorted(r)) for r in simhash.near_edges(spark.createDataFrame(rows, "fp long, h long"), 400).collect()}
    assert edges == {(2 * i, 2 * i + 1) for i in range(200)}


def test_chance_makes_no_candidates(spark, monkeypatch):
    """Texts whose fingerprints are near, as among millions by chance, while their sets have nothing in common."""
    rng = random.Random(6)
    few = lambda t, words=3: sum(1 << b for b in range(4) if len(t) >> b & 1)
    monkeypatch.setattr(simhash, "fingerprint", few)
    base = [[f"w{k}x{i}" for i in range(120)] for k in range(150)]
    texts = [" ".join([*b, *rng.choices(b, k=n)]) for b in base for n in (0, 2)]
    seen, verified = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda groups, *more: seen.append(groups) or verified(groups, *more))
    found = simhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert sorted(tuple(r) for r in found.collect()) == [(i, i - i % 2) for i in range(300)]
    sizes = [r["count"] for r in seen[0].groupBy("comp").count().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 8


def test_sketches_tell_similarity():
    rng = np.random.default_rng(4)
    apart = {0.8: [], 0: []}
    for _ in range(400):
        x = near_copies._mixed(rng.integers(0, 2**63, 400, np.uint64))
        for j, (a, b) in {0.8: (x[:90], x[10:100]), 0: (x[:100], x[200:])}.items():
            apart[j].append((near_copies.sketch(np.unique(a)) ^ near_copies.sketch(np.unique(b))) % 2**64)
    bits = {j: [n.bit_count() for n in found] for j, found in apart.items()}
    assert 5.5 < np.mean(bits[0.8]) < 7.3 and max(bits[0.8]) <= simhash.SKETCH_RADIUS
    assert 31 < np.mean(bits[0]) < 33 and sum(n <= simhash.SKETCH_RADIUS for n in bits[0]) <= 3
    assert near_copies.sketch(np.zeros(0, np.uint64)) == -1


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(50)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert near_copies.shared_counts(sets).tolist() == want


def test_equal_ids_with_different_texts(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(1, one, "x"), (1, two, "y"), (2, one + " more", "z"), (3, two, "u"), (1, one, "again"), (None, one, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _mark string")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicated(df).collect()), key=str)
    assert kept == sorted([(1, one), (1, two), (None, one)], key=str)
