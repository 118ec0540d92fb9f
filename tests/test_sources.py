import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.sources import readers as R


def test_strict_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,x,x\n01,1.5,a\n02,2\n")
    rows = R.numbers_inferred(R.read_csv(spark, str(p)))
    assert rows.columns == ["id", "x", "x [column 3]"]
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("01", 1.5, "a"), ("02", 2.0, None)]
    p.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="too many fields"):
        R.read_csv(spark, str(p)).collect()


def test_lexemes():
    assert R.number_lexemes('{"a": [0.10, 9007199254740993], "b~/": 1e2}') == {"/a/0": "0.10", "/a/1": "9007199254740993", "/b~0~1": "1e2"}
    for bad in ('{"a":1,"a":2}', '{"a":NaN}'):
        with pytest.raises(ValueError):
            R.number_lexemes(bad)


def plain_chunks(text, limit=900, overlap=100):
    ends = [i + 1 for i, c in enumerate(text) if c in "\n。"]
    out, start = [], 0
    while start < len(text):
        end = min(start + limit, len(text))
        if end < len(text):
            end = max([e for e in ends if start + limit // 2 + 1 < e <= end], default=end)
        out.append((start, end, text[start:end]))
        if end == len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def test_chunks(spark):
    rng = random.Random(2)
    texts = ["", "a", "x" * 500 + "\n" + "y" * 900, "\n" * 2000, "z" * 5000, "句。" * 800, *["".join(rng.choice("ab \n。温") if rng.random() < 0.05 else "c" for _ in range(rng.randint(0, 4000))) for _ in range(20)]]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, t string")
    got = {}
    for r in R.chunked(rows, "i", "t").orderBy("i", "place").collect():
        got.setdefault(r["i"], []).append((r["start"], r["stop"], r["chunk"]))
    assert got == {i: plain_chunks(t) for i, t in enumerate(texts) if t}


def test_paragraph_chunks(spark):
    text = "p" * 701 + "\n\n" + "q" * 50 + "\n \n" + "r  \t s" + "\n\n\n"
    rows = spark.createDataFrame([(1, text), (2, None), (3, " \n\n "), (4, "a" * 350 + "\n\n" + "b" * 348 + "\n\nc")], "i int, t string")
    got = {}
    for r in R.paragraph_chunks(rows, "i", "t").orderBy("i", "place").collect():
        got.setdefault(r["i"], []).append(r["chunk"])
    assert got == {1: ["p" * 700, "p" * 81, "q" * 50 + "\nr s"], 4: ["a" * 350 + "\n" + "b" * 348, "c"]}


def test_mesh():
    square = "v 0 0 0\nv 2 0 0\nv 2 2 0\nv 0 2 0\n"
    assert R.mesh_properties(square + "f 1 2 3 4")["area"] == pytest.approx(4)
    dart = "v 0 0 0\nv 2 1 0\nv 0 2 0\nv 1 1 0\nf 1 2 3 4"
    assert R.mesh_properties(dart)["area"] == pytest.approx(1)  # a fan from the first corner gives more
    for bad in (square + "f 1 3 2 4", square + "f 1 2 9", "v 0 0 0\nv 1 0 0\nv 1 1 1\nv 0 1 0\nf 1 2 3 4", square + "f 1 2"):
        with pytest.raises(ValueError):
            R.mesh_properties(bad)


def test_workbook():
    buf = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    assert list(R.workbook_cells(buf.getvalue())) == [("S", 1, 1, "hello", None), ("S", 1, 28, "2", "1+1")]
    assert R.header_row({1: ["1", "2"], 2: ["name", "size", "3"]}) == 2


def test_drawing():
    svg = '<svg><g transform="translate(1,2)"><text x="3" y="4">a <b>b</b></text></g></svg>'
    assert R.svg_texts(svg) == [{"text": "a b", "x": 4.0, "y": 6.0}]
    with pytest.raises(ValueError):
        R.svg_texts("<!DOCTYPE x><svg/>")


def test_tokens(spark):
    row = spark.range(1).select(X.tokens(F.lit("AB 温度")).alias("t"), X.has_identifier(F.lit("see SKU-10"), "SKU-1").alias("a"), X.has_identifier(F.lit("see sku-1."), "SKU-1").alias("b")).first()
    assert row["t"] == ["ab", "温", "度", "ab", "b温", "温度", "ab温", "b温度"] and (row["a"], row["b"]) == (False, True)


def test_decoding(spark):
    rows = [(b"\xef\xbb\xbfabc",), ("温度".encode("gb18030"),), ("温".encode(),)]
    assert [r[0] for r in spark.createDataFrame(rows, "c binary").select(R.decoded("c")).collect()] == ["abc", "温度", "温"]
