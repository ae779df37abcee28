"""Workbooks, array files and work on files one by one."""

import glob
import os
import zipfile

import numpy as np
import pytest

from strideframe.operators import perfile
from strideframe.sources import readers, sinks, workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def make_workbook(path, rows, strings, target="worksheets/links.xml"):
    """rows: XML of the first sheet's rows; a second sheet must not be read."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{DOCUMENT}"><sheets><sheet name="a" sheetId="2" r:id="rId7"/><sheet name="b" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId7" Target="{target}"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        book.writestr("xl/worksheets/links.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        book.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1"><v>9</v></c></row></sheetData></worksheet>')


URL = "https://www.youtube.com/watch?v=abcdefghij"


@pytest.fixture
def books(tmp_path):
    shared = f"<si><t>title</t></si><si><t>url</t></si><si><r><t>{URL}</t></r><r><t>K</t></r><rPh><t>no</t></rPh></si>"
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
    body = '<row r="3"><c r="B3" t="s"><v>2</v></c><c r="AB3"><v>1.5</v></c></row><row r="4"/><row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5" t="e"><v>#REF!</v></c></row>'
    inline = f'<row><c t="inlineStr"><is><t>x</t></is></c><c t="str"><v>{URL}L</v></c></row>'
    make_workbook(tmp_path / "one.xlsx", head + body + inline, shared)
    make_workbook(tmp_path / "many.xlsx", head + "".join(f'<row r="{k}"><c r="B{k}" t="str"><v>{URL}{k % 10}</v></c></row>' for k in range(2, 4502)), shared, "/xl/worksheets/links.xml")
    make_workbook(tmp_path / "broken.xlsx", head + '<row r="2"><c r="B2" t="s"><v>77</v></c></row>', shared)
    make_workbook(tmp_path / "void.xlsx", "", "")
    (tmp_path / "no_zip.xlsx").write_bytes(b"not a workbook")
    whole = (tmp_path / "many.xlsx").read_bytes()
    (tmp_path / "cut.xlsx").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "other.txt").write_text("no workbook at all")
    return str(tmp_path)


def test_workbooks(spark, books):
    rows = workbooks.workbook_rows(spark, books).cache()
    bad = {os.path.basename(r["path"]): r["error"] for r in workbooks.rejected(rows).collect()}
    assert set(bad) == {"broken.xlsx", "no_zip.xlsx", "cut.xlsx"} and all(bad.values())
    one = [(r["ordinal"], r["cells"]) for r in rows.where("path like '%one.xlsx'").orderBy("ordinal").collect()]
    assert one == [(0, ["title", "url"]), (1, [None, URL + "K"] + [None] * 25 + ["1.5"]), (2, ["true", None]), (3, ["x", URL + "L"])]
    many = [(r["ordinal"], r["cells"][1]) for r in rows.where("path like '%many.xlsx'").orderBy("ordinal").collect()]
    assert many == [(0, "url")] + [(k - 1, f"{URL}{k % 10}") for k in range(2, 4502)]
    assert rows.where("path like '%void.xlsx' or path like '%txt'").count() == 0
    links = workbooks.url_workbooks(rows)
    assert links.columns == ["channel_id", "url", "ordinal", "video_id"]
    assert sorted(r["video_id"] for r in links.where("url like '%K' or url like '%L'").collect()) == ["abcdefghijK", "abcdefghijL"]
    assert links.count() == 4502


def test_array_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    arrays = {f"clip {k}": rng.normal(size=(k, 2, 3)) for k in range(5)}
    rows = [(name, list(a.shape), a.reshape(-1).tolist()) for name, a in arrays.items()]
    out = str(tmp_path / "arrays")
    sinks.write_arrays(spark.createDataFrame(rows, "name string, shape array<long>, values array<double>"), out, by=["name"])
    assert len(glob.glob(f"{out}/*/part-*")) == 5
    for name, a in arrays.items():  # plain files, that others can open
        assert np.array_equal(np.load(glob.glob(f"{out}/name={name}/part-*")[0]), a)
    back = readers.read_arrays(spark, out, "part-*", by=["name"]).collect()
    assert {r["name"]: r["shape"] for r in back} == {n: list(a.shape) for n, a in arrays.items()}
    assert all(np.array_equal(np.reshape(r["values"], r["shape"]), arrays[r["name"]]) for r in back)


def test_failed_array_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "arrays")
    rows = [(1, [2], [1.0, 2.0])] * 3 + [(2, [3], [1.0])]
    with pytest.raises(Exception, match="reshape"):
        sinks.write_arrays(spark.createDataFrame(rows, "k int, shape array<long>, values array<double>").repartition(4), out)
    assert not glob.glob(f"{out}/part-*") and not os.path.exists(f"{out}/_SUCCESS")


def test_bytes_as_they_are(spark, tmp_path):
    raw = [bytes(range(256)), b"", b"\xff\n\r\n", None]
    sinks.write_files(spark.createDataFrame([(bytearray(x) if x is not None else None,) for x in raw], "content binary"), str(tmp_path / "f"))
    found = sorted(open(p, "rb").read() for p in glob.glob(str(tmp_path / "f" / "part-*")))
    assert found == sorted((x or b"") + b"\n" for x in raw)


def test_files_one_by_one(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")

    def count_words(path, content):
        words = content.decode().split()
        for k, word in enumerate(words):
            yield k, word
            if word == "bad":
                raise ValueError("a bad word")

    source.mkdir()
    for k in range(9):
        (source / f"{k}.txt").write_text("bad end" if k == 4 else "w " * k + "\n")
    (source / "5.txt").write_bytes(b"\xff")
    run = lambda: perfile.process_files(spark, str(source), "*.txt", count_words, "n int, word string", out, waves=2)
    assert perfile.outcomes(spark, out) is None and perfile.finished(spark, out) is None
    assert run() == 9
    errors = {os.path.basename(r["path"]): r["error"] for r in perfile.failed(spark, out).collect()}
    assert set(errors) == {"4.txt", "5.txt"} and errors["4.txt"] == "ValueError: a bad word"
    assert perfile.finished(spark, out).count() == sum(range(9)) - 4 - 5
    assert run() == 2  # those that failed, alone
    (source / "4.txt").write_text("good")
    os.utime(source / "4.txt", (2_000_000_000, 2_000_000_000))
    assert run() == 2
    assert run() == 1  # the one that still cannot be read
    assert [os.path.basename(r["path"]) for r in perfile.failed(spark, out).collect()] == ["5.txt"]
    assert [r["word"] for r in perfile.finished(spark, out).where("path like '%4.txt'").collect()] == ["good"]
