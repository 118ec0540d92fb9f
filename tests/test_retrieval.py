"""Retrieval operators against plain versions."""

import random
from hashlib import blake2b

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import retrieval as R


def plain_selection(candidates, limit=6):
    """The rules of the choice, one candidate at a time over lists."""
    share = lambda a, b: len(a & b) / max(len(a | b), 1)
    pool, out = dict(enumerate(candidates)), []
    while pool and len(out) < limit:
        most = {k: max((share(set(c[3]), set(o[3])) for o in out), default=0.0) for k, c in pool.items()}
        worth = {k: 0.8 * c[1] + 0.15 * (c[2] not in {o[2] for o in out}) + 0.05 * (1 - most[k]) - 0.2 * most[k] if out else c[1] for k, c in pool.items()}
        allowed = list(pool)
        if len({o[2] for o in out}) == 1:
            allowed = [k for k in pool if pool[k][2] != out[0][2] and most[k] < 0.8] or allowed
        best = min(allowed, key=lambda k: (-worth[k], pool[k][0]))
        c = pool.pop(best)
        if not out or most[best] < 0.95:
            out.append(c)
    return [(c[0], i) for i, c in enumerate(out, 1)]


def test_greedy_choice(spark):
    rng = random.Random(3)
    rows, want = [], []
    for q in range(25):
        base = [f"w{i}" for i in range(30)]
        c = []
        for i in range(rng.randint(1, 25)):
            terms = sorted(rng.sample(base, rng.randint(1, 30))) if rng.random() < 0.7 or not c else list(c[-1][3])
            c.append((i, round(rng.random(), 2), rng.choice(["text", "text", "table"]), terms))
        rows += [(f"q{q}", *x) for x in c]
        want += [(f"q{q}", *x) for x in plain_selection(c)]
    df = spark.createDataFrame(rows, "query string, id long, relevance double, format string, terms array<string>")
    assert sorted(tuple(r) for r in R.selected(df).collect()) == sorted(want)


def test_hashed_vectors(spark):
    texts = [(1, "AB 温度 sensor"), (2, ""), (3, None), (4, "a a a b")]
    got = {r["id"]: r["vector"] for r in R.hashed_vectors(spark.createDataFrame(texts, "i long, t string"), "i", "t", 16).collect()}
    for i, t in texts:
        v = np.zeros(16)
        for token in X.query_tokens(t or ""):
            h = blake2b(token.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "little") % 16] += 1 if h[4] % 2 else -1
        assert np.allclose(got[i], v / (np.linalg.norm(v) or 1))


def test_query_tokens(spark):
    for t in ("AB 温度", "The license_9 of X", "", " a "):
        assert spark.range(1).select(X.tokens(F.lit(t))).first()[0] == X.query_tokens(t)
