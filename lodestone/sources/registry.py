"""Folders of mixed files as one DataFrame: a parser for each extension, and rows that say where they come from.

Files are listed and read by Spark, so any store that Spark reaches will do, and each is parsed in a task, by the parser
that is registered for its extension. (A data source in Python would have to open the files by itself.)"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .readers import header_row, unique_headers, workbook_cells

SCHEMA = "path string, extension string, table string, row long, line_start long, line_end long, values map<string,string>, issue string"
UNKNOWN = "UNSUPPORTED_FORMAT"
BATCH = 10_000  # rows of a file that leave together


@dataclass
class Record:
    table: str  # of the file: a sheet, or root
    row: int  # of the source: a line, or a sheet's row
    last: int  # the line or row that it ends on
    values: dict[str, str | None]


Parser = Callable[[bytes], Iterable[Record]]


@dataclass
class Parsers:
    """Which parser reads which extension; an extension has one."""

    of: dict[str, Parser] = field(default_factory=dict)

    def register(self, extensions: Iterable[str], parser: Parser) -> Parsers:
        named = [x.lower().lstrip(".") for x in extensions]
        taken = sorted(x for x in set(named) if x in self.of or named.count(x) > 1)
        if taken:
            raise ValueError(f"{', '.join(taken)}: registered already")
        self.of.update(dict.fromkeys(named, parser))
        return self


def text_of(content: bytes) -> io.TextIOWrapper:
    """The text of a file as a stream of lines whose ends are as they stand."""
    return io.TextIOWrapper(io.BytesIO(content), encoding="utf-8-sig", newline="")


def delimited(sep: str) -> Parser:
    """Strict delimited text: the first line that isn't blank names the fields; blank lines are left out."""

    def parse(content: bytes) -> Iterator[Record]:
        lines, names, done = csv.reader(text_of(content), delimiter=sep, strict=True), None, 0
        for cells in lines:
            first, done = done + 1, lines.line_num
            if cells and names is None:
                names = unique_headers(cells)
            elif cells:
                if len(cells) > len(names):
                    raise ValueError(f"line {first}: {len(cells)} fields under {len(names)} headings")
                yield Record("root", first, done, {n: c or None for n, c in zip(names, cells, strict=False)})

    return parse


def json_lines(content: bytes) -> Iterator[Record]:
    """An object a line; its fields as they stand, objects and lists as JSON."""
    for i, line in enumerate((line for piece in text_of(content) for line in piece.splitlines()), 1):
        if line.strip():
            record = json.loads(line, parse_int=str, parse_float=str)
            if not isinstance(record, dict):
                raise ValueError(f"line {i}: no object")
            yield Record("root", i, i, {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in record.items()})


def workbook(content: bytes) -> Iterator[Record]:
    """Rows of each sheet under the row that looks like headings; cells without a value are missing."""
    sheets: dict[str, dict[int, dict[int, str]]] = {}
    for sheet, row, column, value, _ in workbook_cells(content):
        if value is not None:
            sheets.setdefault(sheet, {}).setdefault(row, {})[column] = value
    for sheet, rows in sheets.items():
        top, width = max(rows), max(c for cells in rows.values() for c in cells)
        cells_of = lambda r: [rows.get(r, {}).get(c, "") for c in range(1, width + 1)]  # noqa: B023, E731
        at = header_row({r: cells_of(r) for r in range(1, min(top, 30) + 1)}) or min(rows)
        names = unique_headers(cells_of(at))
        for r in sorted(rows):
            if r > at:
                yield Record(sheet, r, r, {names[c - 1]: v for c, v in sorted(rows[r].items())})


def standard() -> Parsers:
    return Parsers().register(["csv"], delimited(",")).register(["tsv", "tab"], delimited("\t")).register(["jsonl", "ndjson"], json_lines).register(["xlsx"], workbook)


def read_files(spark: SparkSession, path: str, parsers: Parsers | None = None) -> DataFrame:
    """Rows (path, extension, table, row, line_start, line_end, values, issue) of all files under a path.

    A file of another extension, or one that its parser refuses, gives one row with an issue and no values, and the rows
    before its fault none: a file is read as a whole or not at all. So it is parsed twice, to see whether it is refused,
    and for its rows, of which a task holds a batch."""
    known = (parsers or standard()).of
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def batch(name: str, extension: str, rows: list[Record], issue: str | None = None) -> pa.RecordBatch:
        n = len(rows) or 1
        values = [list(r.values.items()) for r in rows] if rows else [None]
        where = [[r.table for r in rows], [r.row for r in rows], [r.row for r in rows], [r.last for r in rows]] if rows else [[None]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        cols = [pa.array([name] * n, pa.string()), pa.array([extension] * n, pa.string()), *map(pa.array, where, kinds), pa.array(values, pa.map_(pa.string(), pa.string())), pa.array([issue] * n, pa.string())]
        return pa.RecordBatch.from_arrays(cols, [f.partition(" ")[0] for f in SCHEMA.split(", ")])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, held in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                extension, content = name.rpartition("/")[2].rpartition(".")[2].lower(), held.as_py()
                parser = known.get(extension)
                if not parser:
                    yield batch(name, extension, [], UNKNOWN)
                    continue
                try:
                    for _ in parser(content):
                        pass
                except Exception as e:
                    yield batch(name, extension, [], f"{type(e).__name__}: {e}")
                    continue
                rows = iter(parser(content))
                while some := list(islice(rows, BATCH)):
                    yield batch(name, extension, some)

    return files.mapInArrow(of, SCHEMA)
