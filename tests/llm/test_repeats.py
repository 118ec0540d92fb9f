"""Substring and suffix-array dedup against brute force, and the suffix array itself."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import repeats, substring_dedup, suffix_dedup

LAST = 2**63


def brute_words(rows):
    first, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, LAST + 1), LAST if i is None else i)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (LAST if i is None else i):
                gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows):
    first, out = {}, []
    owner = lambda i: LAST if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 99):
            key = b[k : k + 100]
            first[key] = min(first.get(key, (LAST + 1, 0)), (owner(i), k))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (owner(i), k):
                gone[k : k + 100] = b"\1" * 100
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(params=[(4096, 1 << 19, 8 << 20, 400_000), (3, 700, 3000, 40)])
def sizes(request, monkeypatch):
    """The usual sizes, and ones so small that anchors are hot, texts are cut, groups and subtrees are many."""
    hot, step, group, subtree = request.param
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "GROUP_BYTES", group)
    for module in (repeats, substring_dedup, suffix_dedup):
        monkeypatch.setattr(module, "STEP_BYTES", step)
    monkeypatch.setattr(substring_dedup.Suffixes.deep, "__defaults__", (subtree,))


def test_substrings(spark, corpus, documents, sizes):
    repeats.release()
    got = sorted((tuple(r) for r in substring_dedup.removed(documents).collect()), key=str)
    assert got == brute_words(corpus)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lodestone_")]


def test_suffix_arrays(spark, corpus, documents, sizes):
    got = sorted((tuple(r) for r in suffix_dedup.removed(documents).collect()), key=str)
    assert got == brute_bytes(corpus)


def test_cleaned_keeps_columns(documents, corpus):
    out = substring_dedup.cleaned(documents)
    assert out.columns == documents.columns and out.count() == len(corpus)
    kept = sorted(len((r["text"] or "").split()) for r in out.collect())
    assert kept == sorted(n - gone for _, n, gone, _ in brute_words(corpus))
    assert {r["g"]: r["text"] for r in out.collect()}[0] == corpus[0][1]


def test_empty_tables(no_documents):
    assert substring_dedup.removed(no_documents).collect() == [] and suffix_dedup.removed(no_documents).collect() == []
    assert substring_dedup.cleaned(no_documents).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 4 for x in b)))
def test_suffix_array(text):
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=5, max_size=30).map(lambda b: bytes(x % 2 for x in b)), max_size=6))
def test_equal_windows(contents):
    want, got = {}, {}
    for k, c in enumerate(contents):
        for i in range(len(c) - 4):
            want.setdefault(c[i : i + 5], []).append((k, i))
    for c, k, i in zip(*(x.tolist() for x in suffix_dedup.repeated_windows(contents, 5)), strict=True):
        got.setdefault(c, []).append((k, i))
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for x in want.values() if len(x) > 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=8, max_size=60), st.integers(2, 50))
def test_deep_nodes(words, budget):
    w, depth = np.array(words, np.uint64), 4
    start = np.arange(len(w) - depth + 1)
    want, got = {}, {}
    for i in start.tolist():
        want.setdefault(tuple(words[i : i + depth]), []).append(i)
    for k, (at, node) in enumerate(substring_dedup.Suffixes(w, start, depth).deep(np.zeros(len(start), np.uint64), budget)):
        for a, n in zip(at.tolist(), node.tolist(), strict=True):
            got.setdefault((k, n), []).append(a)
    assert sorted(sorted(x) for x in got.values()) == sorted(x for x in want.values() if len(x) > 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(5, 200))
def test_stretches(lengths, step):
    text = b" ".join(bytes([97 + n % 26]) * n for n in lengths) + b"  "
    for kind in (substring_dedup.Words(), suffix_dedup.Bytes()):
        module = substring_dedup if isinstance(kind, substring_dedup.Words) else suffix_dedup
        old, module.STEP_BYTES = module.STEP_BYTES, step
        try:
            parts = [kind.read([p])[0] for p in kind.stretches(text)]
        finally:
            module.STEP_BYTES = old
        whole = kind.read([text])[0]
        assert np.concatenate([parts[0], *(p[kind.size - 1 :] for p in parts[1:])]).tolist() == whole.tolist()
        assert all(p[: kind.size - 1].tolist() == q[1 - kind.size :].tolist() for q, p in zip(parts, parts[1:], strict=False))


def test_words_that_a_polynomial_takes_for_equal(spark):
    """A Thue-Morse word and its complement: equal under any polynomial modulo a power of two."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    rows = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.removed(rows).orderBy("id").collect()] == [0, 0, 13]
