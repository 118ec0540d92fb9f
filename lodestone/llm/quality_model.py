"""A quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Expectation-maximisation over the counts of vote
patterns (at most 3**8 rows, whatever the data) estimates how each heuristic votes on good and on bad documents.
Posterior labels of a bounded sample then train a logistic scorer over hashed features of words, which
judges every document, also those that no heuristic knows. If the sample lacks good or bad documents, the posteriors
judge alone."""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released

ABSTAIN, GOOD, BAD = 0, 1, 2
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    (
        "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
        "au aux avec ce dans de des du elle en est et il la le les ne par pas plus pour que qui se sur un une "
        "auf das dem den der die ein eine er es für ich im ist mit nicht sich sie so und von wie zu "
        "al como con del el esta las lo los no o para por su una y"
    )
    .encode()
    .split()
)
SYMBOLS, UPPER, LETTERS = b"#*$%&|<>=_~^{}[]\\", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
BUCKETS, SAMPLE, EPOCHS, CACHED = 1 << 16, 8_000, 60, 200_000


def votes(text: bytes) -> list[int]:
    """The heuristics' votes on a text."""
    w = text.split()
    n = len(w)
    if not n:
        return [BAD, ABSTAIN, ABSTAIN, ABSTAIN, ABSTAIN, ABSTAIN, ABSTAIN, ABSTAIN]

    def bad(x: float, limit: float) -> int:
        return BAD if x >= limit else ABSTAIN

    letters = len(text) - len(text.translate(None, LETTERS))
    upper = len(text) - len(text.translate(None, UPPER))
    lines = text.split(b"\n")
    common, again = sum(map(FUNCTION_WORDS.__contains__, w)) / n, sum(map(operator.eq, w, w[1:])) / n
    return [
        GOOD if n >= 20 else ABSTAIN,
        bad((len(text) - len(text.translate(None, SYMBOLS))) / n, 0.2),
        bad(upper / letters, 0.3) if letters >= 20 else ABSTAIN,
        bad(again, 0.2),
        bad((text.count(b"!!") + text.count(b"??")) / n, 0.1),
        bad(sum(x.count(b"|") > 2 for x in lines) / len(lines), 0.3),
        BAD if again >= 0.2 else ABSTAIN if n < 20 or again >= 0.1 else GOOD if common >= 0.15 else BAD if common < 0.03 else ABSTAIN,
        ABSTAIN if n < 10 else GOOD if 3 <= len(text) / n <= 10 else BAD if not 2.5 <= len(text) / n <= 16 else ABSTAIN,
    ]


HEURISTICS = 8
#: These vote good or bad; the others only know bad documents, so that their silence speaks for a document.
TWO_SIDED = (0, 6, 7)


def pattern(v: list[int]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def posteriors(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """pattern -> probability of good, by expectation-maximisation with one latent class for each document."""
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes.tolist()], float)
    v = codes[:, None] // 3 ** np.arange(HEURISTICS) % 3
    seen = np.stack([v == x for x in range(3)], 2).astype(float)  # pattern, heuristic, vote
    seen[:, list(TWO_SIDED), ABSTAIN] = 0  # these say nothing where they abstain
    good, bad, share = np.tile([0.998, 1e-6, 0.002], (HEURISTICS, 1)), np.tile([0.75, 1e-6, 0.25], (HEURISTICS, 1)), 0.7
    good[list(TWO_SIDED)], bad[list(TWO_SIDED)] = [1e-6, 0.95, 0.05], [1e-6, 0.5, 0.5]
    p = np.full(len(codes), share)
    for _ in range(rounds):
        a = np.log(share) + np.einsum("phv,hv->p", seen, np.log(good))
        b = np.log(1 - share) + np.einsum("phv,hv->p", seen, np.log(bad))
        p = 1 / (1 + np.exp(np.clip(b - a, -500, 500)))
        share = min(max(float((n * p).sum() / n.sum()), 0.01), 0.99)
        good, bad = (x / x.sum(1, keepdims=True) for x in (np.einsum("p,phv->hv", n * p, seen) + 0.01, np.einsum("p,phv->hv", n * (1 - p), seen) + 0.01))
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else c for c in range(256))


LONG_RUN = re.compile(rb"(.)\1{2,}", re.S)


def word_features(word: bytes) -> tuple[int, int, int]:
    """Hashed features of a word: itself in lower case, its shape with runs shortened, and its last shape."""
    short = LONG_RUN.sub(rb"\1\1", word.translate(SHAPE))
    return zlib.crc32(word.lower()) % BUCKETS, zlib.crc32(b"\x01" + short) % BUCKETS, zlib.crc32(b"\x02" + short[-2:]) % BUCKETS


class Known(dict):
    """word -> of(word), emptied when full."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes):
        if len(self) >= CACHED:
            self.clear()
        found = self[word] = self.of(word)
        return found


REPEATED = zlib.crc32(b"\x03repeated") % BUCKETS


def features(text: bytes, of: Known) -> tuple[list[int], list[float]]:
    """Buckets, and their shares of the words; empty for a text without words."""
    w = text.split()
    found: Counter = Counter()
    for word, n in Counter(w).items():
        for f in of[word]:
            found[f] += n
    if again := sum(map(operator.eq, w, w[1:])):
        found[REPEATED] += again
    return list(found), [x / len(w) for x in found.values()]


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class Scorer:
    def __init__(self, model: Model):
        weights = model.weights.tolist()
        self.repeated, self.bias = weights[REPEATED], model.bias
        self.words = Known(lambda word: sum(weights[f] for f in word_features(word)))

    def probability(self, text: bytes) -> float:
        """Of being good; 0 for a text without words."""
        w = text.split()
        if not w:
            return 0.0
        total = sum(map(self.words.__getitem__, w)) + self.repeated * sum(map(operator.eq, w, w[1:]))
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / len(w), -500, 500))))


def fitted(sizes: np.ndarray, bucket: np.ndarray, share: np.ndarray, target: np.ndarray, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Logistic regression by Adam over all rows at once; row i has sizes[i] of the buckets and shares. Both classes weigh the same."""
    weights, bias, n = np.zeros(BUCKETS), 0.0, len(sizes)
    at = np.repeat(np.arange(n, dtype=np.int32), sizes)  # of each bucket, its row
    weight = np.where(target > 0.5, 1 / max(target.sum(), 1), 1 / max((1 - target).sum(), 1))
    weight = weight / weight.mean()
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, EPOCHS + 1):
        z = np.bincount(at, share * weights[bucket], n) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / n
        g, gb = np.bincount(bucket, share * error[at], BUCKETS) + decay * weights, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        weights, bias = weights - step * m / (np.sqrt(v) + 1e-9), bias - step * mb / (np.sqrt(vb) + 1e-9)
    return Model(weights, float(bias))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Model | None, dict[int, float]]:
    """The scorer, and the posterior of each vote pattern.

    The votes of all documents are counted. At most sample of them train the scorer, the first by a hash of id, text and
    place in the input, so that rows that repeat are sampled like any others; one task fits it, and the driver gets the
    weights alone. There is no scorer if the sample holds less
    than one document's weight of good or of bad ones; then the posteriors judge."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text, F.monotonically_increasing_id()).alias("h"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            counts.update(pattern(votes(t)) for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    counts = {r["pattern"]: r["n"] for r in rows.select("text").mapInArrow(voted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return None, {}
    known = posteriors(counts)
    share = min(1.0, 1.2 * sample / sum(counts.values()))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Known(word_features)
        for b in batches:
            texts = b.column(0).to_pylist()
            found = [features(t, of) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32())), pa.array([pattern(votes(t)) for t in texts], pa.int64())], ["h", "b", "s", "pattern"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = pa.Table.from_batches(list(batches))
        if not taken.num_rows:
            return
        order = np.argsort(taken["h"].to_numpy().view(np.uint64), kind="stable")[:sample]
        taken = taken.take(pa.array(order)).combine_chunks()
        target = np.array([known[p] for p in taken["pattern"].to_pylist()])
        if min(target.sum(), (1 - target).sum()) < 1:
            return
        sizes = taken["b"].combine_chunks().value_lengths().to_numpy()
        model = fitted(sizes, *[taken[c].combine_chunks().flatten().to_numpy() for c in ("b", "s")], target)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])
        del taken, model
        released()

    drawn = np.sort(rows.where(F.shiftrightunsigned("h", 11) < int(share * 2**53)).select("h").toArrow()["h"].to_numpy().view(np.uint64))  # some more than sample
    if not len(drawn):
        return None, known
    last = int(drawn[:sample][-1:].view(np.int64)[0])
    near = rows.where(F.shiftrightunsigned("h", 1) <= F.shiftrightunsigned(F.lit(last), 1))
    found = near.mapInArrow(featured, "h long, b array<int>, s array<float>, pattern long").repartition(1).mapInArrow(fit, "weights binary, bias double").collect()
    return (Model(np.frombuffer(found[0]["weights"]), found[0]["bias"]) if found else None), known


class Judge:
    """Weak label, score and verdict of a text; without a scorer the weak label is the score."""

    def __init__(self, model: Model | None, known: dict[int, float]):
        self.known, self.scorer = known, Scorer(model) if model else None

    def weak(self, text: bytes) -> float:
        return self.known.get(pattern(votes(text)), 0.5)

    def score(self, text: bytes) -> float:
        if self.scorer:
            return self.scorer.probability(text)
        return self.weak(text) if text.split() else 0.0


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Rows (id, weak, score, kept) for each row of docs: posterior of its votes, probability of the scorer, verdict.

    A null or empty text counts as one without words: it scores 0 and isn't kept. Rows that repeat are scored as often
    as they come; texts are whole, however long; other columns are not looked at. An empty table gives an empty result."""
    model, known = trained(docs, id_col, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model, known))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            scores, weak = [judge.score(t) for t in texts], [judge.weak(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weak), pa.array(scores), pa.array([s >= 0.5 for s in scores])], ["id", "weak", "score", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(of, "id long, weak double, score double, kept boolean")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns, whatever their names. Cases as in scored()."""
    shared, at = docs.sparkSession.sparkContext.broadcast(trained(docs, id_col, text_col, sample)), docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for b in batches:
            yield b.filter(pa.array([judge.score(t or b"") >= 0.5 for t in b.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(of, docs.schema)
