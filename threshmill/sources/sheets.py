"""XLSX sheets in Arrow batches. Operators S8, K8.

A sheet is a zip of XML parts. Reading takes shared and inline strings, numbers
and flags as texts; writing makes inline strings. Files are read whole by one
task each, as the format needs it; many files are many tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: name spaces and the parts that a workbook needs.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{SHEET_NS}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
MOST_ROWS = 1_048_576
BAD_XML = re.compile("[^\t\n\r -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def column_number(reference: str) -> int:
    """0 for A, 26 for AA, of a cell's reference."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def column_name(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def cells(data: bytes) -> list[list[str | None]]:
    """The rows of a workbook's first sheet; empty cells are null."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in item.iter(MAIN + "t")))
    sheet = min((x for x in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: (len(x), x))
    out: list[list[str | None]] = []
    for row in ElementTree.fromstring(book.read(sheet)).iter(MAIN + "row"):
        at = int(row.get("r", len(out) + 1)) - 1
        out += [[] for _ in range(at - len(out) + 1)]
        for cell in row.iter(MAIN + "c"):
            place = column_number(cell.get("r", "")) if cell.get("r") else len(out[at])
            out[at] += [None] * (place - len(out[at]) + 1)
            kind, value = cell.get("t"), cell.findtext(MAIN + "v")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(MAIN + "t"))
            elif kind == "s" and value is not None:
                value = shared[int(value)]
            out[at][place] = value
    return out


def workbook(rows: list[list[str | None]]) -> bytes:
    """A workbook of one sheet of texts."""
    def cell(i: int, j: int, v: str | None) -> str:
        return "" if v is None else f'<c r="{column_name(j)}{i + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(BAD_XML.sub("", v))}</t></is></c>'

    body = "".join(f'<row r="{i + 1}">{"".join(cell(i, j, v) for j, v in enumerate(row))}</row>' for i, row in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, part in PARTS.items():
            book.writestr(name, part)
        book.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{SHEET_NS}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def read_sheets(files: DataFrame, name: str, content: str, columns: list[str], header: int = 0) -> DataFrame:
    """Rows of the first sheets of workbooks (name, bytes), as texts under the given columns, with the file's name and the row's number. The header stands in row `header`; columns that it lacks are null."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, data in zip(batch["name"], batch["content"], strict=True):
                rows = cells(bytes(data))
                head = [str(x).strip() if x is not None else "" for x in rows[header]] if len(rows) > header else []
                place = {c: head.index(c) for c in columns if c in head}
                body = rows[header + 1 :]
                out = {c: pd.Series([r[place[c]] if c in place and place[c] < len(r) else None for r in body], dtype=object) for c in columns}
                yield pd.DataFrame({"file": pd.Series([at] * len(body), dtype=object), "row_number": pd.Series(range(1, len(body) + 1), dtype="int64"), **out})

    fields = ", ".join(f"`{c}` string" for c in columns)
    return files.selectExpr(f"`{name}` AS name", f"`{content}` AS content").mapInPandas(run, f"file string, row_number long, {fields}")


def read_xlsx(spark: SparkSession, path: str, columns: list[str], header: int = 0) -> DataFrame:
    """The workbooks at a path."""
    return read_sheets(spark.read.format("binaryFile").load(path), "path", "content", columns, header)


def as_sheets(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """K8: a workbook (bytes) for each group of rows, in order, with a header. A group is a review sheet; more rows than the format holds raise an error."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) >= MOST_ROWS:
            raise ValueError("more rows than a sheet holds")
        part = part.sort_values(order)
        body = [[None if v is None or v != v else str(v) for v in r] for r in part[columns].itertuples(index=False)]
        return pd.DataFrame({"file": [str(part[group].iloc[0])], "content": [workbook([columns, *body])]})

    return rows.select(group, order, *[c for c in columns if c not in (group, order)]).groupBy(group).applyInPandas(run, "file string, content binary")
