"""Readers of files as DataFrames. Each takes paths that Spark can list, and reads them in tasks.

Delimited and JSON files use Spark's own sources. Workbooks, meshes, drawings and measurement files come as binary rows,
one for each file, and are parsed by Arrow batches in the tasks."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = "jpg jpeg png svg txt md csv json jsonl xlsx pdf obj step stp".split()
IDENTIFIER = re.compile(r"(^|_)(id|code|no|sku|serial|zip|phone)($|_)", re.I)


def unique_headers(names: list[str]) -> list[str]:
    """Names that repeat get the number of their column."""
    seen: set[str] = set()
    out = []
    for i, n in enumerate(names, 1):
        n = n.strip() or f"column {i}"
        out.append(n if n not in seen else f"{n} [column {i}]")
        seen.add(n)
    return out


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Strict delimited text as strings; rows with more fields than the header fail, missing ones at the end are null.

    Fields are those that the parser finds, so quoted separators and line breaks are text, in headings too. Empty fields
    are null. A file that may hold line breaks in quotes is read by one task; use many files, not one large one."""
    layout = {"sep": sep, "multiLine": True, "quote": '"', "escape": '"', "nullValue": "\x01", "emptyValue": ""}
    header = spark.read.csv(path, **layout).limit(1).first()
    names = unique_headers([(x or "").lstrip("\ufeff") for x in header]) if header else []
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("extra", T.StringType())])
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, **layout)
    fits = F.when(F.col("extra").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("too many fields: "), F.to_json(F.struct(*schema.names)))).cast("boolean"))
    return rows.where(fits).select(*[F.nullif(F.col(f"c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)])


def numbers_inferred(df: DataFrame) -> DataFrame:
    """Columns all of whose filled values are numbers become doubles; names and values that look like identifiers stay text."""
    tests = []
    for c in df.columns:
        v = F.trim(F.col(c))
        filled = v != ""
        number = v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$") & ~v.rlike(r"^[+-]?0\d")
        tests.append((F.count_if(filled) > 0) & (F.count_if(filled & ~number) == 0))
    kinds = df.agg(*[t.alias(f"c{i}") for i, t in enumerate(tests)]).first() if tests else []
    return df.select(*[F.col(c).try_cast("double").alias(c) if ok and not IDENTIFIER.search(c) else F.col(c) for c, ok in zip(df.columns, kinds, strict=True)])


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(record VARIANT) of each line; blank lines are left out, broken ones fail."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("record"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("record"))


def json_table(records: DataFrame, path: str) -> DataFrame:
    """Elements of one array of a record as rows; sibling arrays become tables of their own, never a product."""
    items = F.try_variant_get("record", path, "array<variant>")
    return records.select(F.posexplode(items).alias("position", "record"))


def number_lexemes(text: str) -> dict[str, str]:
    """Every number of a JSON text as it is written, by its RFC 6901 pointer; repeated keys and NaN are errors."""

    class Lexeme(str):
        pass

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("a key repeats")
        return out

    def bad(x: str):
        raise ValueError(f"{x} is no JSON number")

    found: dict[str, str] = {}

    def walk(v, at: str) -> None:
        if isinstance(v, Lexeme):
            found[at] = str(v)
        elif isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{at}/{i}")

    walk(json.loads(text, parse_int=Lexeme, parse_float=Lexeme, parse_constant=bad, object_pairs_hook=pairs), "")
    return found


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def lexemes(texts: pd.Series) -> pd.Series:
    return texts.map(number_lexemes)


@F.pandas_udf(T.StringType())
def decoded(contents: pd.Series) -> pd.Series:
    """UTF-8, with or without a mark, else GB 18030; null if it is neither."""

    def of(b: bytes) -> str | None:
        for name in ("utf-8-sig", "gb18030"):
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                continue
        return None

    return contents.map(of)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length", decoded("content").alias("text"))


def chunked(docs: DataFrame, id_col: str, text_col: str, limit: int = 900, overlap: int = 100) -> DataFrame:
    """(id, place, start, stop, chunk): pieces of at most limit characters that overlap.

    A piece ends after its last line break or full stop 。if that stands in its second half. Its successor starts
    overlap characters before its end. Cut points depend on those before, so they are folded over as many steps as a text
    can have pieces; texts themselves are cut once."""
    text, n = F.coalesce(F.col(text_col), F.lit("")), F.col("_n")
    steps = F.sequence(F.lit(0), F.ceil(n / (limit // 2 + 1 - overlap)).cast("int"))

    def cut(state: Column, _: Column) -> Column:
        at = state["at"]
        back = F.reverse(F.substring(F.col("_t"), at + 1, F.lit(limit)))
        places = [F.nullif(F.locate(c, back), F.lit(0)) for c in "\n。"]
        end = F.least(n, at + limit)
        kept = end - F.least(*places) + 1  # after the last of them
        stop = F.when((end < n) & (kept > at + limit // 2 + 1), kept).otherwise(end)
        after = F.when(stop >= n, n).otherwise(F.greatest(at + 1, stop - overlap))
        new = F.struct(after.alias("at"), F.concat(state["cuts"], F.array(F.struct(at.alias("start"), stop.alias("stop")))).alias("cuts"))
        return F.when(at >= n, state).otherwise(new)

    none = F.array().cast("array<struct<start:int,stop:int>>")
    cuts = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("cuts")), cut, lambda state: state["cuts"])
    x = docs.select(F.col(id_col), text.alias("_t"), F.length(text).alias("_n"))
    x = x.select(id_col, "_t", F.posexplode(cuts).alias("place", "c"))
    return x.select(id_col, "place", F.col("c.start").alias("start"), F.col("c.stop").alias("stop"), F.substring(F.col("_t"), F.col("c.start") + 1, F.col("c.stop") - F.col("c.start")).alias("chunk"))


def paragraph_chunks(docs: DataFrame, id_col: str, text_col: str, limit: int = 700, overlap: int = 80) -> DataFrame:
    """(id, place, chunk): paragraphs joined by line breaks while they fit limit characters.

    Runs of blanks count as one, and empty paragraphs as none. One that is longer than limit is cut at every
    limit - overlap characters, and its cuts stand alone."""
    compact = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[ \t]+", " "), r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(compact, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def add(state: Column, p: Column) -> Column:
        now, out = state["now"], state["out"]
        closed = F.when(now != "", F.concat(out, F.array(now))).otherwise(out)
        cuts = F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(limit - overlap)), lambda i: F.substring(p, i + 1, F.lit(limit)))
        fits = F.length(now) + F.length(p) + 1 <= limit
        grown = F.struct(F.when(now == "", p).otherwise(F.concat(now, F.lit("\n"), p)).alias("now"), out.alias("out"))
        return F.when(fits, grown).when(F.length(p) <= limit, F.struct(p.alias("now"), closed.alias("out"))).otherwise(F.struct(F.lit("").alias("now"), F.concat(closed, cuts).alias("out")))

    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))
    chunks = F.aggregate("_p", start, add, lambda s: F.when(s["now"] != "", F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]))
    return docs.select(F.col(id_col), parts.alias("_p")).select(id_col, F.posexplode(chunks).alias("place", "chunk"))


def measurements(files: DataFrame) -> DataFrame:
    """(description, series, time, field, value) of measurement texts: a line, JSON metadata, then tab-separated samples.

    files has path and text."""
    lines = F.split("text", "\r?\n")
    meta = F.parse_json(lines[1])
    x = files.select("path", lines[0].alias("description"), F.try_variant_get(meta, "$.series_id", "string").alias("series"), F.split(lines[2], "\t").alias("names"), F.explode(F.slice(lines, F.lit(4), F.greatest(F.size(lines) - 3, F.lit(0)))).alias("line")).where(F.trim("line") != "")
    x = x.withColumn("cells", F.split("line", "\t"))
    time = F.try_element_at("cells", F.array_position("names", F.lit("timestamp")).cast("int"))
    pairs = F.explode(F.arrays_zip("names", "cells")).alias("pair")
    return x.select("path", "description", "series", F.try_to_timestamp(time).alias("time"), pairs).where(F.col("pair.names") != "timestamp").select("path", "description", "series", "time", F.col("pair.names").alias("field"), F.col("pair.cells").try_cast("double").alias("value"))


def cell_place(ref: str) -> tuple[int, int]:
    """(row, column) of a cell's name, counted from 1."""
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = 26 * column + ord(c) - 64
    if column > 16384 or int(row) > 1_048_576:
        raise ValueError(f"no cell {ref}")
    return int(row), column


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, int, str | None, str | None]]:
    """(sheet, row, column, value, formula) of a workbook; formulas aren't run, their stored values are read."""
    tag = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(si) == "si"]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if tag(e) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
            for cell in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter():
                if tag(cell) != "c":
                    continue
                parts = {tag(e): e for e in cell}
                value = parts["v"].text if "v" in parts else "".join(t.text or "" for t in parts["is"].iter() if tag(t) == "t") if "is" in parts else None
                if cell.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                yield sheet.get("name"), *cell_place(cell.get("r")), value, parts["f"].text if "f" in parts else None


def header_row(rows: dict[int, list[str]]) -> int | None:
    """The first of 30 rows in which 60 % of the cells are different texts."""
    for r in sorted(rows)[:30]:
        texts = {c for c in rows[r] if c and not re.fullmatch(r"[+-]?[\d.]+", c)}
        if rows[r] and len(texts) >= 0.6 * len(rows[r]):
            return r
    return None


def read_xlsx(files: DataFrame) -> DataFrame:
    """(path, sheet, row, column, value, formula) of workbooks; files has path and content."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *c) for p, content in zip(b["path"], b["content"], strict=True) for c in workbook_cells(content)], columns=["path", "sheet", "row", "column", "value", "formula"])

    return files.select("path", "content").mapInPandas(of, "path string, sheet string, row int, column int, value string, formula string")


def flattened(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Fields of records (VARIANT) as columns under their dotted paths; what isn't there is null."""
    return records.select(*[F.try_variant_get("record", "$." + p, kind).alias(p) for p, kind in fields.items()])


def sample_workbook(name: str, number: Column) -> Column:
    """A small workbook with one sheet, for tests of the reader: two headings, a shared text, a formula with its value."""

    @F.pandas_udf(T.BinaryType())
    def made(names: pd.Series, numbers: pd.Series) -> pd.Series:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

        def of(n: str, k: int) -> bytes:
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as z:
                z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="r"><sheets><sheet name="{n}" r:id="rId1"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
                z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>{n}</t></si></sst>")
                z.writestr("xl/charts/chart1.xml", f"<c><ser><f>'{n}'!$A$2:$AB$3</f></ser></c>")
                cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>k</t></is></c></row>'
                z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{cells}<row r="2"><c r="A2" t="s"><v>1</v></c><c r="AB2"><f>B2*2</f><v>{2 * k}</v></c></row></sheetData></worksheet>')
            return buf.getvalue()

        return pd.Series([of(n, k) for n, k in zip(names, numbers, strict=True)])

    return made(name, number)


def chart_ranges(content: bytes) -> Iterator[tuple[str, str, int, int, int, int]]:
    """(chart, sheet, first row, first column, last row, last column) of the ranges that a workbook's charts draw."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/charts/[^/]+\.xml", n)):
            for e in ElementTree.fromstring(z.read(name)).iter():
                if e.tag.rpartition("}")[2] == "f" and (m := re.fullmatch(r"'?(.+?)'?!\$?([A-Z]+)\$?(\d+)(?::\$?([A-Z]+)\$?(\d+))?", e.text or "")):
                    first, last = cell_place(m[2] + m[3]), cell_place((m[4] or m[2]) + (m[5] or m[3]))
                    yield name, m[1].replace("''", "'"), *first, *last


def read_chart_cells(files: DataFrame) -> DataFrame:
    """(path, chart, sheet, row, column, value): the cells that charts of workbooks draw; empty cells have no row."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *c) for p, content in zip(b["path"], b["content"], strict=True) for c in chart_ranges(content)], columns=["path", "chart", "sheet", "r0", "c0", "r1", "c1"])

    ranges = files.select("path", "content").mapInPandas(of, "path string, chart string, sheet string, r0 int, c0 int, r1 int, c1 int")
    inside = F.col("row").between(F.col("r0"), F.col("r1")) & F.col("column").between(F.col("c0"), F.col("c1"))
    return ranges.join(read_xlsx(files), ["path", "sheet"]).where(inside).select("path", "chart", "sheet", "row", "column", "value")


def mesh_of(text: str) -> tuple[np.ndarray, list[list[int]]]:
    """Vertices and faces of an OBJ text; faces count vertices from 0."""
    vertices, faces = [], []
    for line in text.splitlines():
        kind, *rest = line.partition("#")[0].split() or [""]
        if kind == "v":
            vertices.append([float(x) for x in rest[:3]])
        elif kind == "f":
            at = [int(x.split("/")[0]) for x in rest]
            faces.append([i - 1 if i > 0 else len(vertices) + i for i in at])
    v = np.array(vertices, float).reshape(-1, 3)
    if not np.isfinite(v).all() or any(len(f) < 3 or min(f) < 0 or max(f) >= len(v) for f in faces):
        raise ValueError("a mesh needs finite vertices, and faces of three or more of them")
    return v, faces


# How far a corner may lie off its face's plane, absolutely and as a share of the face's size; the least area.
OFF_PLANE, OFF_PLANE_SHARE, LEAST_AREA = 1e-9, 1e-7, 1e-14


def face_area(corners: np.ndarray) -> np.ndarray:
    """The area of a flat simple polygon as a vector along its normal: half the sum of its corners' cross products.

    No triangles are needed: Stokes' theorem gives the area from the edges, whether the polygon is convex or not. Raises
    for polygons without area, with corners off their plane, or whose edges cross or touch."""
    at = corners - corners[0]
    area = np.cross(at, np.roll(at, -1, axis=0)).sum(0) / 2
    if len(at) == 3:
        return area
    size, span = float(np.linalg.norm(area)), float(np.linalg.norm(np.ptp(at, axis=0)))
    if 2 * size <= LEAST_AREA * max(1.0, span**2):
        raise ValueError("a face has no area")
    normal = area / size
    if np.abs(at @ normal).max() > max(OFF_PLANE, OFF_PLANE_SHARE * span):
        raise ValueError("a face isn't flat")
    flat = np.delete(at, np.abs(normal).argmax(), axis=1) / (span or 1.0)  # its shadow along the steepest axis, of size one
    if edges_meet(flat):
        raise ValueError("a face crosses itself")
    return area


def edges_meet(p: np.ndarray) -> bool:
    """Whether two edges of a plane polygon that aren't neighbours have a point in common."""
    q, n = np.roll(p, -1, axis=0), len(p)
    turn = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    a, b, c, d = p[:, None], q[:, None], p[None], q[None]
    sides = [np.where(np.abs(t) < 1e-12, 0, np.sign(t)) for t in (turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b))]
    apart = (np.maximum(p, q)[:, None] < np.minimum(p, q)[None] - 1e-12).any(2)
    meet = (sides[0] * sides[1] <= 0) & (sides[2] * sides[3] <= 0) & ~apart & ~apart.T
    gap = np.abs(np.arange(n)[:, None] - np.arange(n))
    return bool((meet & (gap > 1) & (gap < n - 1)).any())


def mesh_properties(text: str) -> dict:
    """Size, area, volume (null unless the mesh is closed, oriented and without degenerate faces), and a form vector.

    The vector holds the shares of the three principal moments, area and volume over the scale that the moments give, the
    logarithms of the numbers of faces and of bodies, and closedness."""
    v, faces = mesh_of(text)
    size = np.ptp(v, axis=0) if len(v) else np.zeros(3)
    middle = v.mean(0) if len(v) else np.zeros(3)
    repeats = any(len(set(face)) < len(face) for face in faces)
    if any(len(face) > 3 and len(set(face)) < len(face) for face in faces):
        raise ValueError("a face repeats a corner")
    sided = np.array([face_area(v[face]) for face in faces]).reshape(-1, 3)
    areas = np.linalg.norm(sided, axis=1)
    degenerate = repeats or bool((areas <= np.finfo(float).eps * max(float(size @ size), 1e-20)).any())
    edges = np.array([(face[i - 1], face[i]) for face in faces for i in range(len(face))], int).reshape(-1, 2)
    closed = bool(len(edges)) and bool((np.unique(np.sort(edges, axis=1), axis=0, return_counts=True)[1] == 2).all())
    oriented = closed and bool((np.unique(edges, axis=0, return_counts=True)[1] == 1).all())
    pyramids = np.einsum("ij,ij->i", v[[face[0] for face in faces]] - middle, sided) / 3 if faces else np.zeros(0)  # over each face, to the middle
    volume = abs(float(pyramids.sum())) if closed and oriented and not degenerate else None
    moments = np.sort(np.linalg.eigvalsh(np.cov((v - v.mean(0)).T)))[::-1] if len(v) > 2 else np.zeros(3)
    total = float(moments.sum())
    scale = total**0.5 if total > 0 else float(np.linalg.norm(size)) or 1.0
    form = [*(moments / (total or 1.0)), areas.sum() / scale**2, (volume or 0.0) / scale**3, np.log1p(len(faces)) / 20, np.log1p(1) / 5, float(closed)]
    return {"size": size.tolist(), "area": float(areas.sum()), "volume": volume, "closed": closed, "oriented": oriented, "degenerate": degenerate, "features": np.array(form, np.float32).astype(float).tolist()}


MESH = T.StructType(
    [
        T.StructField("size", T.ArrayType(T.DoubleType())),
        T.StructField("area", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("closed", T.BooleanType()),
        T.StructField("oriented", T.BooleanType()),
        T.StructField("degenerate", T.BooleanType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
    ]
)


@F.pandas_udf(MESH)
def mesh_columns(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mesh_properties(t) for t in texts])


def affine(text: str) -> np.ndarray:
    """The 3 x 3 matrix of an SVG transform list."""
    m = np.eye(3)
    for name, args in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        x = [float(p) for p in re.split(r"[\s,]+", args.strip()) if p]
        if name == "translate":
            step = [[1, 0, x[0]], [0, 1, x[1] if len(x) > 1 else 0], [0, 0, 1]]
        elif name == "scale":
            step = [[x[0], 0, 0], [0, x[1] if len(x) > 1 else x[0], 0], [0, 0, 1]]
        elif name == "rotate":
            t = np.radians(x[0])
            turn = np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
            to = np.array([[1, 0, x[1]], [0, 1, x[2]], [0, 0, 1]]) if len(x) > 2 else np.eye(3)
            step = to @ turn @ np.linalg.inv(to)
        elif name in ("skewX", "skewY"):
            lean = np.tan(np.radians(x[0]))
            step = [[1, lean, 0], [0, 1, 0], [0, 0, 1]] if name == "skewX" else [[1, 0, 0], [lean, 1, 0], [0, 0, 1]]
        elif name == "matrix" and len(x) == 6:
            step = [[x[0], x[2], x[4]], [x[1], x[3], x[5]], [0, 0, 1]]
        else:
            raise ValueError(f"transform {name}")
        m = m @ np.array(step)
    return m


def svg_texts(content: str) -> list[dict]:
    """Texts of a drawing with the place that its transforms move them to; entities and doctypes are refused."""
    if re.search(r"<!(DOCTYPE|ENTITY)", content, re.I):
        raise ValueError("a drawing may not declare entities")
    out = []

    def walk(e: ElementTree.Element, m: np.ndarray) -> None:
        m = m @ affine(e.get("transform", ""))
        if e.tag.rpartition("}")[2] == "text":
            x, y, _ = m @ np.array([float(e.get("x", 0)), float(e.get("y", 0)), 1])
            out.append({"text": " ".join("".join(e.itertext()).split()), "x": float(x), "y": float(y)})
        for child in e:
            walk(child, m)

    walk(ElementTree.fromstring(content), np.eye(3))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def drawing_texts(contents: pd.Series) -> pd.Series:
    return contents.map(svg_texts)


def captions(record: DataFrame) -> DataFrame:
    """(file, n, captions) of a captions file: images and annotations, two tables of one record, joined by image."""
    images = json_table(record, "$.images").select(F.try_variant_get("record", "$.id", "bigint").alias("image"), F.substring_index(F.try_variant_get("record", "$.file_name", "string"), "/", -1).alias("file"))
    notes = json_table(record, "$.annotations").select(F.try_variant_get("record", "$.image_id", "bigint").alias("image"), F.try_variant_get("record", "$.caption", "string").alias("caption"))
    return images.join(notes, "image").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("caption")).alias("captions"))


def format_of(path: Column) -> Column:
    """The kind of asset by a file's extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"image": ("jpg", "jpeg", "png", "svg"), "text": ("txt", "md", "pdf"), "table": ("csv", "xlsx", "parquet"), "json": ("json", "jsonl"), "geometry": ("obj", "step", "stp")}
    out = F.when(F.lit(False), F.lit(""))
    for kind, exts in kinds.items():
        out = out.when(ext.isin(*exts), F.lit(kind))
    return out.otherwise(F.lit("other"))
