"""Text functions: tokens of Latin and CJK text, whole-token identifiers, names of files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[a-z0-9_]+|[一-鿿]"
OUTSIDE = "A-Za-z0-9_-"


def words(text: Column) -> Column:
    """Latin words and single CJK characters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def with_value(value: Column, of) -> Column:
    """of(value), with the value computed once however often of names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def characters(text: Column) -> Column:
    """The characters of the text in lower case without white space."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"\s+", ""), ""), lambda c: c != "")


def ngrams(chars: Column, n: int) -> Column:
    """Runs of n of the characters; linear in their number."""
    runs = chars
    for i in range(1, n):
        runs = F.zip_with(runs, F.slice(chars, F.lit(i + 1), F.greatest(F.size(chars) - i, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.slice(runs, F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(0)))


def tokens(text: Column) -> Column:
    """Words, then runs of two and of three characters."""
    return F.concat(words(text), with_value(characters(text), lambda c: F.concat(ngrams(c, 2), ngrams(c, 3))))


def tokens_in(words: Column, characters: Column) -> Column:
    """How many tokens a text of so many words and characters has."""
    return words + F.greatest(characters - 1, F.lit(0)) + F.greatest(characters - 2, F.lit(0))


def token_count(text: Column) -> Column:
    """The size of tokens(text), which are not made."""
    low = F.lower(text)
    return tokens_in(F.regexp_count(low, F.lit(WORDS)), F.char_length(F.regexp_replace(low, r"\s+", "")))


def occurrences(text: Column, run: str) -> Column:
    """How often a run of characters stands in the text; places may overlap."""
    if any(run[:i] == run[-i:] for i in range(1, len(run))):
        return F.regexp_count(text, F.lit(f"(?={re.escape(run)})"))
    left = F.octet_length(F.replace(text, F.lit(run), F.lit("")))
    return ((F.octet_length(text) - left) / len(run.encode())).cast("int")


def query_tokens(text: str) -> list[str]:
    """The tokens of one short text, on the driver."""
    compact = re.sub(r"\s+", "", text.lower())
    return re.findall(WORDS, text.lower()) + [compact[i : i + n] for n in (2, 3) for i in range(len(compact) - n + 1)]


def question_terms(text: Column) -> Column:
    """Distinct Latin words and pairs of CJK characters that follow each other, other characters between them or not."""
    low = F.lower(text)
    pairs = lambda c: F.slice(F.zip_with(c, F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.concat(a, b)), F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), with_value(F.regexp_extract_all(low, F.lit("[一-鿿]"), F.lit(0)), pairs)))


def has_identifier(text: Column, identifier: str) -> Column:
    """Whether the identifier stands in the text as a whole token, not inside a longer one."""
    return text.rlike(f"(?i)(?<![{OUTSIDE}]){re.escape(identifier)}(?![{OUTSIDE}])")


def overlap(query: Column, terms: Column) -> Column:
    """Share of the query's distinct terms that the other list holds."""
    return F.size(F.array_intersect(query, terms)) / F.greatest(F.size(F.array_distinct(query)), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def file_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([A-Za-z0-9]+)$", 1))


def language_guess(text: Column) -> Column:
    return F.when(text.rlike(r"[一-鿿]"), F.lit("zh")).otherwise(F.lit("en"))


def json_pointer(pointer: str) -> str:
    """An RFC 6901 pointer as a JSON path."""
    out = "$"
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        out += f"[{part}]" if part.isdigit() else f"['{part}']"
    return out


def cell_place(name: Column) -> Column:
    """(col, row) of a spreadsheet cell's name, counted from 1; nulls if it isn't one of A1 to XFD1048576."""
    letters, row = F.regexp_extract(name, "^([A-Z]{1,3})([1-9][0-9]{0,6})$", 1), F.regexp_extract(name, "^([A-Z]{1,3})([1-9][0-9]{0,6})$", 2).try_cast("long")
    col = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s * 26 + F.ascii(c) - 64)
    good = (col > 0) & (col <= 16384) & (row <= 1_048_576)
    return F.struct(F.when(good, col).alias("col"), F.when(good, row).alias("row"))


def stop_phrases_removed(text: Column, phrases: list[str]) -> Column:
    """text in lower case without the phrases, longest first."""
    out = F.lower(text)
    for p in sorted(phrases, key=len, reverse=True):
        out = F.replace(out, F.lit(p.lower()), F.lit(" "))
    return out


def terms(text: Column, phrases: list[str]) -> Column:
    """Distinct Latin words of two characters or more and runs of two CJK characters, without stop phrases."""
    bare = stop_phrases_removed(text, phrases)
    latin = F.regexp_extract_all(bare, F.lit("[a-z0-9_]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(bare, F.lit("[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(latin, pairs))


def uuid_of(namespace: str, name: Column) -> Column:
    """The name-based identifier (version 5) of a name in a namespace: SHA-1 of both, with version and variant set."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    nibble = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 4), F.lit("-5"), F.substring(raw, 14, 3), F.lit("-"), nibble, F.substring(raw, 18, 3), F.lit("-"), F.substring(raw, 21, 12))
