"""SentencePiece vocabularies as unigram models: Viterbi encoding, decoding and token counts.

The vocabulary is read on the driver from a .model file, whose path is a parameter, and broadcast: it holds some ten
thousands of pieces whatever the data. Segmentations maximise the sum of the pieces' scores; on equal sums the longer
last piece wins. That is what the library does: tests compare ids and counts with it, on texts of any length.

Texts are encoded in a stream. A boundary that no piece can span is one where all paths converge: before a run of word
marks or a line break, if no piece holds one after another character. What lies between two of these, mostly a word, is
committed at once, and a bounded cache keeps it. Inside a longer run a window of the longest piece is kept, and ids are
committed whenever all paths that are still alive converge."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, UNKNOWN_PENALTY = "▁", 10.0
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A score below this says that nothing but a piece may do; it counts as one less than the others, or it would drown all sums.
NEVER = -1e6
CACHED = 200_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class Vocabulary:
    """The pieces of a model; built on the driver, sent to the tasks."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix, self.byte_fallback = True, False
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, NORMAL)))
            elif number == 2:
                self.byte_fallback = bool(dict(_fields(value)).get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                    raise ValueError("only models that leave the text as it is are supported")
                self.dummy_prefix = bool(f.get(3, 1))
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNK)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}
        least = min(s for _, s, kind in self.pieces if kind == NORMAL and s >= NEVER)
        self.pieces = [(p, least - 1 if kind == NORMAL and s < NEVER else s, kind) for p, s, kind in self.pieces]
        scores = [s for _, s, kind in self.pieces if kind == NORMAL]
        self.unk_score = min(scores) - UNKNOWN_PENALTY
        top = max(scores)
        self.scored = {p: (i, len(p.encode()) * top - 0.1 if kind == USER else s) for i, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.longest = max(map(len, self.scored))
        self.cuts = all(not re.search(f"[^{c}]{c}", p) for p in self.scored for c in (MARK, "\n"))

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read())

    def parts(self, text: str) -> list[str]:
        """The text with its marks, cut where no piece can span the boundary."""
        if not text:
            return []
        whole = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+", whole) if self.cuts else [whole]

    def spelled(self, char: str) -> tuple[int, ...]:
        """The ids of a character that no piece covers."""
        return tuple(self.bytes[b] for b in char.encode("utf-8", "replace")) if self.byte_fallback else (self.unk,)


class Encoder:
    """Viterbi over one vocabulary. Aho-Corasick gives its matches; those that end at one place come longest first."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in vocabulary.scored.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.singles = frozenset(p for p in vocabulary.scored if len(p) == 1)
        self.lone_break = not any("\n" in p for p in vocabulary.scored)
        self.cache = Cache(self.part)

    def stream(self, part: str) -> Iterator[tuple[int, ...]]:
        """The ids of a part in order, in runs that are yielded once nothing that follows can change them.

        best[i] holds score, start and id of the best path that ends at i, for the boundaries not yet committed."""
        best: dict[int, tuple[float, int, int]] = {0: (0.0, -1, -1)}
        done, n, unk, window = 0, len(part), self.v.unk, self.v.longest
        matches = self.automaton.iter(part)
        at, found = next(matches, (-1, None))

        def path(upto: int) -> tuple[int, ...]:
            out = []
            while upto > done:
                _, start, piece = best[upto]
                out.append(self.v.spelled(part[start]) if piece == unk else (piece,))
                upto = start
            return tuple(chain.from_iterable(reversed(out)))

        for i in range(n):
            score, start, piece = float("-inf"), -1, unk
            while at == i:
                length, s, one = found
                if (now := best[i + 1 - length][0] + s) > score:
                    score, start, piece = now, i + 1 - length, one
                at, found = next(matches, (-1, None))
            if part[i] not in self.singles and (now := best[i][0] + self.v.unk_score) > score:
                score, start, piece = now, i, unk
            best[i + 1] = (score, start, piece)
            if (i + 1) % window == 0 and i + 1 < n:
                alive = set(range(max(i + 2 - window, done), i + 2))  # where pieces still to come can start
                while len(alive) > 1 and (last := max(alive)) > done:
                    alive.remove(last)
                    alive.add(max(best[last][1], done))
                if (commit := alive.pop()) > done:
                    yield path(commit)
                    for k in range(done, commit):
                        del best[k]
                    done = commit
        if n > done:
            yield path(n)

    def short(self, part: str) -> tuple[int, ...]:
        """The same for a part inside one window all of whose characters are pieces: nothing is unknown or committed early."""
        n = len(part)
        score, start, piece = [0.0] + [float("-inf")] * n, [0] * (n + 1), [0] * (n + 1)
        for end, (length, s, one) in self.automaton.iter(part):
            end += 1
            at = end - length
            if (now := score[at] + s) > score[end]:
                score[end], start[end], piece[end] = now, at, one
        out = []
        while n:
            out.append(piece[n])
            n = start[n]
        return tuple(out[::-1])

    def part(self, part: str) -> tuple[int, ...]:
        if self.lone_break and len(part) > 1 and part[0] == "\n":
            return self.cache["\n"] + self.cache[part[1:]]
        if len(part) <= self.v.longest and self.singles.issuperset(part):
            return self.short(part)
        return tuple(chain.from_iterable(self.stream(part)))

    def ids(self, text: str) -> list[int]:
        """All ids of a text."""
        return list(chain.from_iterable(map(self.cache.__getitem__, words(self.v, text))))


class Counter(Encoder):
    """Counts pieces without building them: only score and count are kept, for the boundaries that a piece can reach."""

    def window(self, part: str) -> int:
        """The number of pieces of a part."""
        v, size = self.v, self.v.longest + 1
        score, count = [0.0] * size, [0] * size
        matches = self.automaton.iter(part)
        end, found = next(matches, (-1, None))
        for i in range(len(part)):
            best, n = float("-inf"), 0
            while end == i:
                length, s, _ = found
                at = (i + 1 - length) % size
                if (now := score[at] + s) > best:
                    best, n = now, count[at] + 1
                end, found = next(matches, (-1, None))
            at = i % size
            if part[i] not in self.singles and (now := score[at] + v.unk_score) > best:
                best, n = now, count[at] + len(v.spelled(part[i]))
            at = (i + 1) % size
            score[at], count[at] = best, n
        return count[len(part) % size]

    def short(self, part: str) -> int:
        """The same for a part inside one window all of whose characters are pieces."""
        n = len(part)
        score, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for end, (length, s, _) in self.automaton.iter(part):
            end += 1
            at = end - length
            if (now := score[at] + s) > score[end]:
                score[end], count[end] = now, count[at] + 1
        return count[n]

    def part(self, part: str) -> int:
        if self.lone_break and len(part) > 1 and part[0] == "\n":
            return self.cache["\n"] + self.cache[part[1:]]
        if len(part) <= self.v.longest and self.singles.issuperset(part):
            return self.short(part)
        return self.window(part)

    def count(self, text: str) -> int:
        """The number of a text's pieces."""
        return sum(map(self.cache.__getitem__, words(self.v, text)))


class Cache(dict):
    """part -> result, for parts of usual length. When it is full, what it holds becomes old, and what was old is forgotten:
    memory is bounded, and frequent parts stay."""

    def __init__(self, of, longest: int = 64):
        super().__init__()
        self.of, self.longest, self.old = of, longest, {}

    def __missing__(self, part: str):
        found = self.old.get(part)
        if found is None:
            found = self.of(part)
        if len(part) <= self.longest:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found


def words(v: Vocabulary, text: str) -> list[str]:
    """v.parts(text); the common case, single spaces between words, is cut without a regular expression."""
    if v.cuts and v.dummy_prefix and MARK not in text:
        cut = text.replace("\n", " \n").split(" ")
        if "" not in cut:
            return [w if w[0] == "\n" else MARK + w for w in cut]
    return v.parts(text)


class Decoder:
    """ids -> text; bytes are joined into characters, and those that form none become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        text = {CONTROL: lambda p: "", UNK: lambda p: " \u2047 ", BYTE: lambda p: chr(int(p[3:5], 16))}
        self.texts = [text.get(kind, lambda p: p.replace(MARK, " "))(p) for p, _, kind in vocabulary.pieces]
        self.names = {i: b for b, i in vocabulary.bytes.items()}
        self.high = frozenset(i for i, b in self.names.items() if b > 127)

    def text(self, ids: list[int]) -> str:
        if self.high.isdisjoint(ids):
            whole = "".join(map(self.texts.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in self.names:
                    run.append(self.names[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(self.texts[i])
            whole = "".join([*out, run.decode("utf-8", "replace")])
        return whole[1:] if self.v.dummy_prefix and whole[:1] == " " else whole


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids, n_ids, decoded_sha256, round_trip) for each row of docs.

    A null or empty text has no ids. The decoded text equals the text unless that holds U+2581 itself, which
    the vocabulary uses for spaces. Rows that repeat are encoded as often as they come; texts are whole, however long;
    other columns are not looked at. An empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                flat, ends, hashes, same = array("i"), [0], [], []
                for t in b.column(1).to_pylist():
                    ids = encoder.ids(t or "")
                    flat.extend(ids)
                    ends.append(len(flat))
                    back = decoder.text(ids)
                    hashes.append(hashlib.sha256(back.encode()).hexdigest())
                    same.append(back == (t or ""))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.array([], np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array(hashes, pa.string()), pa.array(same, pa.bool_())], ["id", "ids", "n_ids", "decoded_sha256", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "id long, ids array<int>, n_ids long, decoded_sha256 string, round_trip boolean")


def counted(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens) for each row of docs: as many as encoded() gives ids. Cases as there."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            counts = [counter.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "id long, n_tokens long")
