"""Workbooks are read back by their parts; differences of two tables."""

import datetime as dt
import re
import zipfile
import xml.etree.ElementTree as ET

import pytest

from swelter.operators.compare import differences
from swelter.sinks import workbook

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def test_workbook_parts_and_values(spark, tmp_path):
    rows = [(1, 2.5, dt.date(2001, 2, 3), 'a <b> & "c"', True), (None, None, None, None, None), (-7, float("nan"), dt.date(1900, 3, 1), "", False)]
    df = spark.createDataFrame(rows, "a int, b double, c date, d string, e boolean").coalesce(1)
    path = str(tmp_path / "b.xlsx")
    workbook.write_workbook(path, {"first": df, "none": df.limit(0)})
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        for name in names:
            ET.fromstring(z.read(name))
        targets = {f"xl/{t}" for t in re.findall(r'Target="([^"]+)"', z.read("xl/_rels/workbook.xml.rels").decode())}
        assert targets <= names and [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{NS['m']}}}sheet")] == ["first", "none"]
        sheet = ET.fromstring(z.read("xl/worksheets/sheet1.xml"))
        cells = {c.get("r"): "".join(c.itertext()) for c in sheet.iter(f"{{{NS['m']}}}c")}
        assert sheet.find("m:dimension", NS).get("ref") == "A1:E4"
        assert cells == {"A1": "a", "B1": "b", "C1": "c", "D1": "d", "E1": "e", "A2": "1", "B2": "2.5", "C2": "36925", "D2": 'a <b> & "c"', "E2": "1", "A4": "-7", "C4": "61", "D4": "", "E4": "0"}
    assert [workbook.column_letters(n) for n in (1, 26, 27, 52, 53, 702, 703)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_archives_are_checked(spark, tmp_path):
    path, bad = str(tmp_path / "b.xlsx"), str(tmp_path / "bad.xlsx")
    workbook.write_workbook(path, {"first": spark.createDataFrame([(1, None), (2, 0.5)], "a int, b double").coalesce(1), "none": spark.range(0)})
    assert workbook.problems(path) == []
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}

    def damaged(**changes):
        with zipfile.ZipFile(bad, "w") as z:
            for n, text in parts.items():
                key = n if n.endswith(".rels") else n.rpartition("/")[2].split(".")[0].strip("[]")
                new = changes.get(key, lambda t: t)(text)
                if new is not None:
                    z.writestr(n, new)
        return " ".join(workbook.problems(bad))

    assert damaged() == ""
    assert "sheet2.xml, which is not there" in damaged(sheet2=lambda t: None)
    assert "sheet1.xml has no content type" in damaged(Content_Types=lambda t: t.replace("sheet1.xml", "sheet9.xml"))
    assert "two sheets are called first" in damaged(workbook=lambda t: t.replace('"none"', '"First"'))
    assert "sheet none has no link" in damaged(workbook=lambda t: t.replace("rId2", "rId77"))
    assert "it says A1:B9 and has B3" in damaged(sheet1=lambda t: t.replace('dimension ref="A1:B3"', 'dimension ref="A1:B9"'))
    assert "row 3 follows row 1" in damaged(sheet1=lambda t: re.sub('<row r="2">.*?</row>', "", t))
    assert "says another row" in damaged(sheet1=lambda t: t.replace('r="A2"', 'r="A5"'))
    (tmp_path / "text.xlsx").write_text("no archive")
    assert "no archive" in workbook.problems(str(tmp_path / "text.xlsx"))[0]
    whole = open(path, "rb").read()
    (tmp_path / "cut.xlsx").write_bytes(whole[: len(whole) // 2])
    assert workbook.problems(str(tmp_path / "cut.xlsx"))


def test_numbers_are_shown_by_their_size(spark, tmp_path):
    assert [workbook.number_style(x) for x in (0.0, -2e6, 123.4, 5.5, -0.25, 0.01)] == [4, 3, 4, 5, 5, 6]
    path = str(tmp_path / "b.xlsx")
    workbook.write_workbook(path, {"s": spark.createDataFrame([(0.01, 1)], "a_column_of_a_long_name double, b int")})
    with zipfile.ZipFile(path) as z:
        sheet, styles = ET.fromstring(z.read("xl/worksheets/sheet1.xml")), ET.fromstring(z.read("xl/styles.xml"))
    assert [c.get("s") for c in sheet.iter(f"{{{NS['m']}}}c")][2:] == ["6", None] and len(styles.find("m:cellXfs", NS)) == 7
    assert [int(c.get("width")) for c in sheet.iter(f"{{{NS['m']}}}col")] == [len("a_column_of_a_long_name") + 3, 9]


def test_tables_beyond_a_sheet_are_refused(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    with pytest.raises(ValueError, match="1048576 rows"):
        workbook.write_workbook(str(path), {"long": spark.range(workbook.MOST_ROWS)})
    with pytest.raises(ValueError, match="can't name"):
        workbook.write_workbook(str(path), {"a/b": spark.range(1)})
    assert not path.exists()


def test_differences(spark):
    schema = "k int, x double, s string"
    a = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, None, None), (4, 4.0, "d"), (None, 1.0, "n")], schema)
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "a"), (2, 2.1, "c"), (3, None, None), (5, 5.0, "e"), (None, 1.0, "n")], schema)
    got = {(r.k, r.problem, r.column, r.left, r.right) for r in differences(a, b, ("k",)).collect()}
    assert got == {(2, "differs", "x", "2.0", "2.1"), (2, "differs", "s", "b", "c"), (4, "only left", None, None, None), (5, "only right", None, None, None)}
    assert differences(a, a, ("k",)).count() == 0
    assert {(r.problem, r.column) for r in differences(a, a.drop("s"), ("k",)).collect()} == {("column of one", "s")}
