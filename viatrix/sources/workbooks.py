"""Sheets of workbooks: zipped XML parts, of which one lists the sheets, one the shared texts, and each sheet has its own."""

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd

#: fixed values: names of the format's own elements
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def column_number(reference: str) -> int:
    """A1 is 0, AA1 is 26."""
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def cells(content: bytes, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 0, texts) of a sheet's rows that have cells; a sheet that the workbook lacks is a KeyError."""
    tag = lambda name: f"{{{MAIN}}}{name}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        named = {s.get("name"): s.get(f"{{{LINK}}}id") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(tag("sheet"))}
        parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter(tag("t"))) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))]
        place = parts[named[sheet]]
        rows = ElementTree.fromstring(z.read(place.lstrip("/") if place.startswith("/") else f"xl/{place}")).iter(tag("row"))
        for nth, row in enumerate(rows):
            out: list[str | None] = []
            for cell in row.iter(tag("c")):
                at = column_number(cell.get("r") or "") if cell.get("r") else len(out)
                out += [None] * (at + 1 - len(out))
                value, kind = cell.find(tag("v")), cell.get("t")
                if kind == "inlineStr":
                    out[at] = "".join(t.text or "" for t in cell.iter(tag("t")))
                elif value is not None:
                    out[at] = shared[int(value.text)] if kind == "s" else value.text
            yield int(row.get("r") or nth + 1) - 1, out


def rows_of(sheet: str, names: list[str], header: int):
    """A function for mapInPandas: rows below the header line ``header`` as texts, by the columns' names; blank rows are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                found, at = [], None
                for number, row in cells(bytes(content), sheet):
                    if number == header:
                        at = [row.index(n) if n in row else None for n in names]
                    elif at is not None and any(x is not None for x in row):
                        found.append([row[i] if i is not None and i < len(row) else None for i in at])
                yield pd.DataFrame(found, columns=names, dtype=object)

    return run


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of small tables, numbers as numbers and anything else as text."""

    def cell(x) -> str:
        if x is None:
            return "<c/>"
        return f"<c><v>{x}</v></c>" if isinstance(x, (int, float)) else f'<c t="inlineStr"><is><t>{escape(str(x))}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8"?>'
    numbered = list(enumerate(sheets.items(), 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i, _ in numbered)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r0" Type="{LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{LINK}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>' for i, (name, _) in numbered) + "</sheets></workbook>")
        for i, (_, rows) in numbered:
            body = "".join(f'<row r="{k}">{"".join(map(cell, row))}</row>' for k, row in enumerate(rows, 1) if row)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
