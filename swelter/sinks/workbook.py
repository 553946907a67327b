"""Small result tables as a workbook (Office Open XML), a copy beside the Parquet tables."""

from __future__ import annotations

import datetime as dt
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Row

#: Fixed value: rows of a sheet, its header included.
MOST_ROWS = 1_048_576
_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Cell styles: plain, header, date, and numbers of 0, 2, 4 and 6 places.
_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FFD9D9D9"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="7"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf numFmtId="14" applyNumberFormat="1"/>'
    + "".join(f'<xf numFmtId="{n}" applyNumberFormat="1"/>' for n in (3, 4, 164, 165)) + "</cellXfs></styleSheet>"
).replace("<fonts", '<numFmts count="2"><numFmt numFmtId="164" formatCode="0.0000"/><numFmt numFmtId="165" formatCode="0.000000"/></numFmts><fonts', 1)
#: Widths of columns, in characters.
LEAST_WIDTH, MOST_WIDTH = 9, 40


def column_letters(n: int) -> str:
    """A, B, ..., Z, AA, ... for 1, 2, ..."""
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def number_style(value: float) -> int:
    """The style that shows a number: the smaller it is, the more places."""
    size = abs(value)
    return 3 if size >= 1e5 else 4 if size >= 100 or value == 0 else 5 if size >= 0.1 else 6


def _widths(columns: list[str], kinds: list[str]) -> str:
    """Columns as wide as their names and what is usual for their kind."""
    usual = {"date": 11, "string": 24, "double": 14}
    wide = [min(MOST_WIDTH, max(LEAST_WIDTH, len(c) + 3, usual.get(k, 0))) for c, k in zip(columns, kinds)]
    return "<cols>" + "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(wide, 1)) + "</cols>"


def _cell(at: str, value) -> str:
    """Null is an empty cell; what is no number or date is text."""
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    if isinstance(value, float) and abs(value) != float("inf"):
        return f'<c r="{at}" s="{number_style(value)}"><v>{value!r}</v></c>'
    if isinstance(value, dt.date):
        return f'<c r="{at}" s="2"><v>{(value - dt.date(1899, 12, 30)).days}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _sheet(columns: list[str], kinds: list[str], rows: Iterator[Row], n: int) -> Iterator[str]:
    last = f"{column_letters(len(columns))}{n + 1}"
    yield f'{_HEAD}<worksheet xmlns="{_MAIN}"><dimension ref="A1:{last}"/><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>{_widths(columns, kinds)}<sheetData>'
    yield '<row r="1">' + "".join(f'<c r="{column_letters(i)}1" s="1" t="inlineStr"><is><t>{escape(c)}</t></is></c>' for i, c in enumerate(columns, 1)) + "</row>"
    for k, row in enumerate(rows, 2):
        yield f'<row r="{k}">' + "".join(_cell(f"{column_letters(i)}{k}", v) for i, v in enumerate(row, 1)) + "</row>"
    yield f'</sheetData><autoFilter ref="A1:{last}"/></worksheet>'


def write_workbook(path: str, sheets: dict[str, DataFrame]) -> None:
    """One sheet for each table, with a frozen header and a filter; rows come partition by partition.

    A table that doesn't fit a sheet is an error before anything is written.
    """
    counts = {name: df.count() for name, df in sheets.items()}
    for name, n in counts.items():
        if n + 1 > MOST_ROWS:
            raise ValueError(f"{name} has {n} rows; a sheet holds {MOST_ROWS - 1} beside its header")
        if len(name) > 31 or set(name) & set("[]:*?/\\"):
            raise ValueError(f"{name!r} can't name a sheet")
    part = lambda kind: f"application/vnd.openxmlformats-officedocument.spreadsheetml.{kind}+xml"
    numbers = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{part("worksheet")}"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{part("sheet.main")}"/><Override PartName="/xl/styles.xml" ContentType="{part("styles")}"/>{overrides}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + f'<Relationship Id="rId{len(sheets) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        for i, (name, df) in zip(numbers, sheets.items()):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                for text in _sheet(df.columns, [t for _, t in df.dtypes], df.toLocalIterator(), counts[name]):
                    f.write(text.encode())


def problems(path: str) -> list[str]:
    """What is wrong with a workbook's archive: parts that are missing or not named, sheets whose cells aren't where they say."""
    out: list[str] = []
    try:
        z = zipfile.ZipFile(path)
    except (OSError, zipfile.BadZipFile) as e:
        return [f"no archive: {e}"]
    with z:
        if bad := z.testzip():
            return [f"{bad} is damaged"]
        held = set(z.namelist())
        out += [f"{n} is missing" for n in ("[Content_Types].xml", "_rels/.rels", "xl/workbook.xml", "xl/_rels/workbook.xml.rels") if n not in held]
        if out:
            return out
        named = {e.get("PartName", "").lstrip("/") for e in ElementTree.fromstring(z.read("[Content_Types].xml"))}
        links = {e.get("Id"): f"xl/{e.get('Target')}" for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out += [f"a link leads to {t}, which is not there" for t in links.values() if t not in held]
        out += [f"{t} has no content type" for t in links.values() if t in held and t not in named]
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).findall(f".//{{{_MAIN}}}sheet")
        names = [s.get("name") for s in sheets]
        out += [f"two sheets are called {n}" for n in {n.lower() for n in names if [m.lower() for m in names].count(n.lower()) > 1}]
        for s in sheets:
            part = links.get(s.get(f"{{{_REL}}}id"))
            if part is None:
                out.append(f"sheet {s.get('name')} has no link")
            elif part in held:
                out += [f"sheet {s.get('name')}: {p}" for p in _sheet_problems(z, part)]
    return out


def _sheet_problems(z: zipfile.ZipFile, part: str) -> Iterator[str]:
    said, last_row, last_column = None, 0, 0
    with z.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            tag = e.tag.rpartition("}")[2]
            if tag == "dimension":
                said = e.get("ref")
            elif tag == "c":
                letters = e.get("r").rstrip("0123456789")
                column = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters)))
                last_column = max(last_column, column)
            elif tag == "row":
                row = int(e.get("r"))
                if row != last_row + 1:
                    yield f"row {row} follows row {last_row}"
                if any(not c.get("r").endswith(str(row)) or c.get("r").rstrip("0123456789") + str(row) != c.get("r") for c in e):
                    yield f"a cell of row {row} says another row"
                last_row = row
                e.clear()
    if said != f"A1:{column_letters(max(1, last_column))}{last_row}":
        yield f"it says {said} and has {column_letters(max(1, last_column))}{last_row}"


#: The workbooks of a study and their tables.
BOOKS = {
    "Heatwaves": ("heatwave_events", "cell_thresholds"), "Regional_Heatwaves": ("regional_days", "regional_day_cells", "daily_extent"),
    "Heatwave_Clusters": ("clusters", "cluster_cells", "daily_settings", "sequences"), "Heatwave_Ellipses": ("ellipses",), "Compound_Heatwaves": ("compound_events", "event_days"),
    "Analysis_Summary": ("event_type_summary", "annual_counts", "annual_duration", "duration_trends"), "Power_Law": ("power_law_fits",), "Intensity": ("intensity_parameters", "intensity", "centroids", "centroid_concentration"),
}


def write_workbooks(folder: str, tables: dict[str, DataFrame]) -> list[str]:
    """The study's books whose tables are all there, in a local folder; their paths."""
    out = []
    for book, names in BOOKS.items():
        if set(names) <= set(tables):
            out.append(f"{folder}/{book}.xlsx")
            write_workbook(out[-1], {n: tables[n] for n in names})
    return out
