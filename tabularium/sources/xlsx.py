"""Workbooks: the first sheet of an xlsx file, whose first row is the header.

The file comes through Spark's binary reader, so it may be in any store that Spark reads. A sheet has 2**20 rows at
most; it is parsed by one task.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.ship import ship
from tabularium.functions.storage import put
from tabularium.sources.delimited import inferred

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the built-in formats that show a date.
_DATE_FORMATS = {*range(14, 23), 45, 46, 47}


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def rows(data: bytes) -> Iterator[list[str | None]]:
    """The cells of the first sheet's rows as texts, each row as long as its last cell's column."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet").get(_RELATION)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[first]
        sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dates = _date_styles(book.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        with book.open(sheet) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for k, cell in enumerate(node.iter(f"{_MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else k
                    out += [None] * (at + 1 - len(out))
                    out[at] = _value(cell, shared, dates)
                yield out
                node.clear()


def _date_styles(data: bytes) -> set[int]:
    root = ElementTree.fromstring(data)
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode").lower()))}
    cells = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _value(cell, shared: list[str], dates: set[int]) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _text(cell)
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    if kind is None and int(cell.get("s", -1)) in dates:
        return str(datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(value.text)))
    number = value.text
    return number[:-2] if kind is None and re.fullmatch(r"-?\d+\.0", number) else number


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content").to_pylist():
            held: list[list[str | None]] = []
            for k, row in enumerate(rows(data)):
                held.append(row)
                if len(held) == 5000:
                    yield _packed(k - len(held) + 1, held)
                    held = []
            if held:
                yield _packed(k - len(held) + 1, held)


def _packed(first: int, held: list[list[str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], names=["pos", "cells"])


def read(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    cells = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_cells, "pos long, cells array<string>")
    head = cells.where("pos = 0").select("cells").first()
    if head is None:
        raise ValueError(f"{path}: the first sheet is empty")
    names = [h if h not in (None, "") else f"Unnamed: {k}" for k, h in enumerate(head[0])]
    return inferred(cells.where("pos > 0").select(*[F.get("cells", k).alias(n) for k, n in enumerate(names)]))


#: Rows of a sheet, the header among them.
MOST_ROWS = 1 << 20


def write(df: DataFrame, path: str) -> str:
    """Writes a table as the one sheet of a workbook: numbers, booleans, all else as text. More rows than a sheet can have are an error."""
    rows = df.limit(MOST_ROWS).collect()
    if len(rows) >= MOST_ROWS:
        raise ValueError(f"a sheet has {MOST_ROWS} rows at most")
    lines = [_line(1, df.columns), *(_line(k, row) for k, row in enumerate(rows, 2))]
    main = f'xmlns="{_MAIN[1:-1]}"'
    relation = _RELATION[1:].partition("}")[0]
    package = relation.replace("officeDocument", "package")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{relation}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{relation}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return put(df.sparkSession, path, out.getvalue())


def _line(number: int, values: Sequence[object]) -> str:
    cells = []
    for k, value in enumerate(values):
        at = f'r="{_letters(k)}{number}"'
        if isinstance(value, bool):
            cells.append(f'<c {at} t="b"><v>{int(value)}</v></c>')
        elif isinstance(value, (int, float)):
            cells.append(f"<c {at}><v>{value!r}</v></c>")
        elif value is not None:
            cells.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out = chr(65 + k % 26) + out
        k = k // 26 - 1
    return out
