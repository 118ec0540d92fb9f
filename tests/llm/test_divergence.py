import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from lodestone.llm import divergence as D
from lodestone.llm import queries


def plain(rows, most=200, least=3):
    """The audit from its definition: every term of every group."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for text, lang, source in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        held[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept} if kept else {}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            f = lambda a, b: (a - b) ** 2 // b
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, top in (("pair", pair, len(pair)), ("term", term, most)):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(sorted(items)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def audit(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcDEé") for _ in range(rng.randint(1, 4))) for _ in range(700)] + ["ÄÖ", "中文", "x"]
    own = {s: words[i * 60 : i * 60 + 90] for i, s in enumerate("s t u v".split())}
    rows = []
    for _ in range(400):
        s = rng.choice(["s"] * 5 + ["t", "u", "v"])
        pick = [rng.choice(words if rng.random() < 0.5 else own[s]) for _ in range(rng.randint(0, 80))]
        rows.append((rng.choice([" ", "-1", "\n", "' "]).join(pick), rng.choice(["en", "de"]), s))
    rows += [(None, "en", "s"), ("", "en", "void"), ("12 34", "en", None), ("a b", None, None), ("a a", "fr", "s"), ("lone", "xx", "one"), ("z " * 5000 + "Z" * 5000, "en", "t")]
    rows += [rows[0]] * 4
    df = spark.createDataFrame([(i, *r, 1, 0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term int, count int").repartition(5)
    at = str(tmp_path_factory.mktemp("audit"))
    df.write.parquet(f"{at}/documents.parquet")
    return at, df, rows


def test_against_plain(spark, audit):
    at, _, rows = audit
    assert sorted(map(tuple, queries.op12_source_divergence(spark, at).collect())) == plain(rows)


def test_few_terms_and_ties(audit):
    _, df, rows = audit
    for most in (1, 7):
        assert sorted(map(tuple, D.audited(df, most=most, least_docs=1).collect())) == plain(rows, most, 1)


def test_against_sql(spark, audit):
    at, _, _ = audit
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{at}/documents.parquet/*.parquet'")
    want = db.sql(f"SELECT lang, source, part, item, value, rank FROM ({queries.OP12_SQL})").fetchall()
    assert sorted(map(tuple, queries.op12_source_divergence(spark, at).collect())) == sorted(want)


def test_long_texts_and_flushes(spark, monkeypatch):
    text = ("Ab" * 40 + " " + "cd-") * 50 + "é" * 300
    want = re.findall(r"[a-zA-Z\x80-\U0010ffff]+", text)
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(D, "STRETCH", size)
        assert [t.decode() for ts in D.terms_of(text.encode()) for t in ts] == [w.translate({ord(c): c.lower() for c in "ABC"}) for w in want]


def test_shares_beyond_longs(spark):
    df = spark.createDataFrame([(10**15, 3 * 10**15, 10**6)], "c long, n long, v long")
    assert df.select(D.share("c", "n", "v")).first()[0] == 1 + 10**9 * (10**15 + 1) // (3 * 10**15 + 10**6)


def test_no_rows(no_documents):
    assert D.audited(no_documents).collect() == []
