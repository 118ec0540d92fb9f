import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import periodic_runs as P
from lodestone.llm import queries


def plain_runs(x, least=12):
    """Every maximal stretch with each period, kept if no smaller period holds it."""
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def ours(x):
    return P.searched([[str(w).encode() for w in x]])[0]


def by_hand(doc_id, text):
    """The whole row of the query from its contract, word by word."""
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in runs), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_small_alphabets(x):
    assert ours(x) == plain_runs(x)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 6)), max_size=12))
def test_powers(blocks):
    x = [w for block, times in blocks for w in block * times]
    assert ours(x) == plain_runs(x)


def test_agreements():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ([rng.randint(0, 1) for _ in range(rng.randint(1, 12))] for _ in range(2))
        want = [next((k for k in range(len(p) + 1) if k == len(p) or i + k == len(t) or p[k] != t[i + k])) for i in range(len(t))]
        assert P.agreements(np.array(p), np.array(t)).tolist() == want


def test_fibonacci_and_long_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert ours(b) == plain_runs(b)
    assert ours([7] * 5000) == [(0, 5000, 1)]
    assert ours(list(range(700)) * 3) == [(0, 2100, 700)]
    assert ours(list(range(700)) * 2 + [5] * 11) == [(0, 1400, 700)]


def test_texts_do_not_meet():
    w = [str(i).encode() for i in range(6)]
    assert P.searched([w, w, w * 2]) == [[], [], [(0, 12, 6)]]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab c dé".split()) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    texts += [" ".join(str(rng.randint(0, 400)) for _ in range(300)) for _ in range(60)]
    texts += [None, "", " \t\n", "x", "w " * 3000, "a b c  " * 30, "one two\nthree\tfour\x0bfive\x0csix\r" * 4, "\x1fa " * 20]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(3, texts[4], 0, "x"), (3, texts[4], 0, "x"), (None, texts[0], 0, "x")]
    at = str(tmp_path_factory.mktemp("periodic"))
    spark.createDataFrame(rows, "doc_id long, text string, runs int, id string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at, [r[:2] for r in rows]


def test_query_against_the_contract(spark, written):
    at, rows = written
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, at).collect()), key=str)
    assert got == sorted((by_hand(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 15


def test_no_rows(spark, no_documents):
    assert P.detected(no_documents).collect() == []
    assert P.detected(no_documents).columns == ["id", "n_words", "runs", "collapsed"]
