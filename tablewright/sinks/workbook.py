"""Spreadsheet files (Office Open XML) from cells, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import safe_name, write_files
from .naming import sheet_names

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?")
_BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _numeric(column: Iterable[str | None]) -> bool:
    """Whether all values of a column that are there are plain numbers: no leading zeros, no more digits than a double
    keeps."""
    given = [v for v in column if v is not None]
    return bool(given) and all(_NUMBER.fullmatch(v) and sum(c.isdigit() for c in v) <= 15 for v in given)


def _cell(at: str, value: str, number: bool) -> str:
    if number:
        return f'<c r="{at}"><v>{value}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", value))}</t></is></c>'


def _sheet(rows: list[list[str | None]]) -> str:
    """A header and rows. Columns of plain numbers are numbers; texts are inline strings, so that one beginning with = is
    no formula; None is left out."""
    out = [f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS}"><sheetData>']
    numeric = [_numeric(r[j] if j < len(r) else None for r in rows[1:]) for j in range(max(map(len, rows), default=0))]
    for i, row in enumerate(rows, 1):
        cells = (_cell(f"{letters(j)}{i}", v, i > 1 and numeric[j - 1]) for j, v in enumerate(row, 1) if v is not None)
        out.append(f'<row r="{i}">{"".join(cells)}</row>')
    out.append("</sheetData></worksheet>")
    return "".join(out)


def workbook(sheets: list[tuple[str, list[list[str | None]]]]) -> bytes:
    """The bytes of a workbook of (name, rows) sheets."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACK}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACK}/relationships">{rels}</Relationships>')
        for i, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(rows))
    return out.getvalue()


def read_workbook(data: bytes) -> dict[str, list[list[str | int | float | None]]]:
    """Sheets of a workbook that workbook() made."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS}}}sheet")]
        out = {}
        for i, name in enumerate(names, 1):
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{_NS}}}row"):
                got: list[str | int | float | None] = []
                for c in row.iter(f"{{{_NS}}}c"):
                    at = 0
                    for ch in re.match("[A-Z]+", c.get("r"))[0]:
                        at = at * 26 + ord(ch) - 64
                    got += [None] * (at - 1 - len(got))
                    number = c.find(f"{{{_NS}}}v")
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS}}}t"))
                    got.append(text if number is None else float(number.text) if "." in number.text else int(number.text))
                rows.append(got)
            out[name] = rows
    return out


def workbooks(cells: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """doc_id, content: one workbook for each document, a sheet for each table and one of notes (doc_id, page_no, note, and
    table_no and row_no if known) in this order, if there are any. A document's tables meet in one task, as its file is
    one."""
    tables = sheet_names(cells.select("doc_id", "page_no", "table_no").distinct())
    rows = cells.join(tables, ["doc_id", "page_no", "table_no"]).select("doc_id", "position", "sheet", "row_no", "col_no", "col_name", "value")
    if notes is not None:
        order = Window.partitionBy("doc_id").orderBy("page_no", *(c for c in ("table_no", "row_no") if c in notes.columns), "note")
        pairs = F.posexplode(F.array(F.struct(F.lit("Page").alias("n"), F.concat(F.lit("Page "), F.col("page_no").cast("string")).alias("v")), F.struct(F.lit("Note").alias("n"), F.col("note").alias("v"))))
        noted = notes.select("doc_id", "note", "page_no", F.row_number().over(order).alias("r")).select("doc_id", "r", pairs.alias("col_no", "x"))
        rows = rows.union(noted.select("doc_id", F.lit(2**31 - 1), F.lit("Notes"), "r", "col_no", "x.n", "x.v"))

    def build(pdf):
        import pandas as pd

        sheets = []
        for (_, sheet), t in pdf.groupby(["position", "sheet"], sort=True):
            header = t.drop_duplicates("col_no").sort_values("col_no")
            wide = t.pivot(index="row_no", columns="col_no", values="value").sort_index()
            body = [[None if v is None or v != v else v for v in r] for r in wide[list(header["col_no"])].itertuples(index=False)]
            sheets.append((sheet, [[v or None for v in header["col_name"]], *body]))
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "content": [workbook(sheets)]})

    kind = cells.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("doc_id").applyInPandas(build, f"doc_id {kind}, content binary")


def write_workbooks(books: DataFrame, folder: str | None = None) -> None:
    """Write each workbook to its path (a column), or to folder/<doc_id>.xlsx, from the tasks that made it."""
    if folder is not None:
        books = books.withColumn("path", F.concat(F.lit(f"{folder}/"), safe_name(F.col("doc_id")), F.lit(".xlsx")))
    write_files(books)
