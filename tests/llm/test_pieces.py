import os
import random
import struct
from itertools import chain

import pytest

from lodestone.llm import pieces as P
from lodestone.llm.queries import MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")


@pytest.fixture(scope="module")
def v():
    return P.Vocabulary.read(MODEL)


def brute(v, text):
    """Viterbi over the whole text by trying every piece at every place; ties go to the longer last piece."""
    whole = ("▁" + text.replace(" ", "▁")) if text else ""
    best = [(0.0, [])] + [None] * len(whole)
    for end in range(1, len(whole) + 1):
        for start in range(max(0, end - v.longest), end):
            p = whole[start:end]
            if p in v.scored:
                i, s = v.scored[p]
                if best[end] is None or best[start][0] + s > best[end][0]:
                    best[end] = (best[start][0] + s, best[start][1] + [i])
        c = whole[end - 1]
        if c not in v.scored and (best[end] is None or best[end - 1][0] + v.unk_score > best[end][0]):
            best[end] = (best[end - 1][0] + v.unk_score, best[end - 1][1] + list(v.spelled(c)))
    return best[-1][1]


TEXTS = ["", "a", " a", "  two  spaces ", "The the erntre.\nNew line\n\nend", "日本語 テスト \x01", "x" * 700, "🙂 ok", "a\n b", "thehe in tion", "a▁b ▁ c", "▁"]


@pytest.mark.parametrize("text", TEXTS)
def test_against_brute_force(v, text):
    want = brute(v, text)
    e, c = P.Encoder(v), P.Counter(v)
    whole = "".join(P.words(v, text))
    assert e.ids(text) == want and c.count(text) == len(want)
    assert list(chain.from_iterable(e.stream(whole))) == want
    assert c.window(whole) == len(want)
    assert P.Decoder(v).text(want) == text.replace("▁", " ")


def test_stream_keeps_a_window(v):
    e, rng = P.Encoder(v), random.Random(1)
    text = "".join(rng.choice("theraningd") for _ in range(4000))
    runs = list(e.stream(text))
    assert len(runs) > 50 and max(map(len, runs)) < 200
    assert list(chain.from_iterable(runs)) == list(e.part(text))


@pytest.fixture(scope="module")
def library():
    """The library and our vocabulary over the same pieces as a unigram model, those never to be chosen just unlikely."""
    sp = pytest.importorskip("sentencepiece")
    data = bytearray(open(MODEL, "rb").read())
    trainer = next(x for n, x in P._fields(bytes(data)) if n == 2)
    at, start = 0, bytes(data).rfind(trainer)
    while True:
        key = trainer[at]
        if key == 3 << 3:
            data[start + at + 1] = 1
            break
        if key & 7 == 2:
            n, at = trainer[at + 1], at + 2
            if n > 127:
                n, at = n & 127 | trainer[at] << 7, at + 1
            at += n
        else:
            at += 2
            while trainer[at - 1] > 127:
                at += 1
    data = bytes(data).replace(struct.pack("<f", -1e9), struct.pack("<f", -40000.0))
    return sp.SentencePieceProcessor(model_proto=data), P.Vocabulary(data)


def test_against_the_library(library):
    library, v = library
    rng = random.Random(6)
    syllables = "th er in on the and re ed nd ou ea ti to it st ing is ch en ió ñ ß é 日 本 🙂 ▁ \n".split(" ")
    texts = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    texts = [" ".join(rng.choice(texts) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    e, c = P.Encoder(v), P.Counter(v)
    for text in texts:
        want = library.encode(text)
        assert e.ids(text) == want and c.count(text) == len(want)


def test_long_text_against_the_library(library):
    library, v = library
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 14))) for _ in range(20_000))
    want = library.encode(text)
    assert P.Encoder(v).ids(text) == want and P.Counter(v).count(text) == len(want)


def test_queries(spark, documents, corpus, no_documents, v):
    rows = P.encoded(documents, MODEL).collect()
    counts = sorted((r["id"] or 0, r["n_tokens"]) for r in P.counted(documents, MODEL).collect())
    assert len(rows) == len(corpus) and all(r["round_trip"] for r in rows)
    assert sorted((r["id"] or 0, r["n_ids"]) for r in rows) == counts and all(len(r["ids"]) == r["n_ids"] for r in rows)
    assert P.encoded(no_documents, MODEL).collect() == [] and P.counted(no_documents, MODEL).collect() == []
    marked = P.encoded(spark.createDataFrame([(1, "a▁b"), (1, "a▁b")], "doc_id long, text string"), MODEL).collect()
    assert len(marked) == 2 and not marked[0]["round_trip"]
