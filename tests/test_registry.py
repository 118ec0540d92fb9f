"""Delimited text as its parser reads it, and folders of mixed files."""

import io
import zipfile

import pytest
from pyspark.errors import PySparkException

from lodestone.sources import readers, registry


def test_quoted_breaks_and_commas(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,"two\nlines",id\n1,"x\ny",3\n2,"x,y,z"\n"3",,"q ""q"""\n', encoding="utf-8")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["id", "two\nlines", "id [column 3]"]
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "x\ny", "3"), ("2", "x,y,z", None), ("3", None, 'q "q"')]
    assert rows.select("id").count() == 3
    (tmp_path / "b.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(PySparkException, match="too many fields"):
        readers.read_csv(spark, str(tmp_path / "b.csv")).collect()


def book() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    cell = lambda at, text: f'<c r="{at}" t="inlineStr"><is><t>{text}</t></is></c>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1">{cell("A1", "title")}</row><row r="3">{cell("A3", "name")}{cell("B3", "size")}{cell("C3", "name")}</row><row r="5">{cell("A5", "n")}<c r="B5"><v>2</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_mixed_folder(spark, tmp_path):
    at = tmp_path / "in" / "deep"
    at.mkdir(parents=True)
    (tmp_path / "in" / "a.CSV").write_text('\nk,v\n1,"x\ny"\n\n2\n')
    (at / "b.tsv").write_text("k\tv\n1\t\n")
    (at / "c.jsonl").write_text('{"k":9007199254740993,"v":[1.10]}\n\n{"k":null}\n')
    (at / "bad.csv").write_text("k\n1\n1,2\n")
    (at / "d.bin").write_bytes(b"\xff")
    (at / "e.xlsx").write_bytes(book())
    (at / "none.csv").write_text("")
    rows = registry.read_files(spark, str(tmp_path / "in")).collect()
    got = {}
    for r in rows:
        got.setdefault(r["path"].rpartition("/")[2], []).append((r["table"], r["line_start"], r["line_end"], r["values"], r["issue"]))
    assert sorted(got["a.CSV"], key=str) == [("root", 3, 4, {"k": "1", "v": "x\ny"}, None), ("root", 6, 6, {"k": "2"}, None)]
    assert got["b.tsv"] == [("root", 2, 2, {"k": "1", "v": None}, None)]
    assert got["c.jsonl"] == [("root", 1, 1, {"k": "9007199254740993", "v": '["1.10"]'}, None), ("root", 3, 3, {"k": None}, None)]
    assert got["e.xlsx"] == [("S", 5, 5, {"name": "n", "size": "2"}, None)]
    assert got["d.bin"] == [(None, None, None, None, "UNSUPPORTED_FORMAT")] and "none.csv" not in got
    assert len(got["bad.csv"]) == 1 and "line 3" in got["bad.csv"][0][4]


def test_an_extension_has_one_parser():
    p = registry.standard()
    for taken in (["CSV"], [".tsv"], ["new", "NEW"]):
        with pytest.raises(ValueError, match="registered already"):
            p.register(taken, registry.json_lines)
    assert "new" not in p.of


def test_files_are_verified_as_they_are_read(spark, tmp_path):
    import hashlib

    from lodestone.sources import sinks

    for name, text in (("ok", "a"), ("long", "ab"), ("other", "b"), ("extra", "x")):
        (tmp_path / name).write_text(text)
    base = f"file:{tmp_path}"
    sha = hashlib.sha256(b"a").hexdigest()
    listed = spark.createDataFrame([(f"{base}/{n}", sha.upper() if n == "ok" else sha, 1) for n in ("ok", "long", "other", "gone")], "path string, sha256 string, size long")
    got = {r["path"].rpartition("/")[2]: (r["status"], r["content"]) for r in sinks.verified(spark, str(tmp_path), listed).collect()}
    assert got == {"ok": ("OK", bytearray(b"a")), "long": ("SIZE_MISMATCH", None), "other": ("SHA256_MISMATCH", None), "extra": ("UNLISTED", None), "gone": ("MISSING", None)}


def test_rows_of_a_file_leave_in_batches(spark, tmp_path, monkeypatch):
    """A file's rows were one list of Python objects and one batch; a fault behind the first batch still refuses the file."""
    from lodestone.sources import registry

    lines = [f'{i},"a\u2028b"' for i in range(25_000)]
    (tmp_path / "good.csv").write_text("k,v\r\n" + "\r\n".join(lines) + "\r\n")
    (tmp_path / "bad.csv").write_text("k,v\n" + "\n".join(lines) + "\n1,2,3\n")
    (tmp_path / "l.jsonl").write_bytes(b'\xef\xbb\xbf{"k": 1}\r\n\n{"k": 2}\x0b{"k": 3}\r{"k": 4}')
    found = registry.read_files(spark, str(tmp_path))
    good = found.where("path like '%good.csv'")
    assert good.count() == 25_000 and good.where("line_start <> values['k'] + 2 or values['v'] <> 'a\u2028b'").isEmpty()
    assert [r["issue"] for r in found.where("path like '%bad.csv'").collect()] == ["ValueError: line 25002: 3 fields under 2 headings"]
    assert [(r["row"], r["values"]["k"]) for r in found.where("extension = 'jsonl'").orderBy("row").collect()] == [(1, "1"), (3, "2"), (4, "3"), (5, "4")]
    assert registry.BATCH == 10_000
