import random

import pytest


def prose(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(id, text) rows with copies, shared passages, repeats inside a text, empty, null and long texts."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgéö") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    passage = prose(rng, 40, words)
    texts = [prose(rng, rng.randint(0, 120), words) for _ in range(60)]
    texts += [texts[3], texts[3] + " tail", "Head " + texts[4], passage + " " + texts[5], texts[6] + "\n" + passage, texts[7] + " " + texts[7]]
    texts += ["", None, "a", "x " * 400, "é" * 300, prose(rng, 3000, words) + " " + passage]
    rows = list(enumerate(texts, 1))
    return rows + [(5, texts[9]), (None, texts[10])]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns whose names clash with inner ones."""
    rows = [(i, t, "src0" if k % 3 else None, "en", k, k, "x") for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, g int, row long, id string").repartition(5).cache()


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
