"""DOCX and XLSX by the standard library: archives of XML parts.

Each file becomes blocks with regions (text, confidence); one Arrow pass, no shuffle. A file that
cannot be read gives one row with the error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from docflow.operators.batches import map_tuples

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows shown of a table and of a sheet, formulas shown.
TABLE_ROWS, SHEET_ROWS, FORMULAS = 10, 5, 20


@dataclass
class Region:
    kind: str
    text: str
    confidence: float
    metadata: dict[str, object] = field(default_factory=dict)


@dataclass
class Block:
    page: int
    label: str
    title: str
    regions: list[Region]
    metadata: dict[str, object] = field(default_factory=dict)


def table_text(rows: list[list[str]]) -> str:
    """First row, a rule of 50 dashes, the other rows."""
    return "\n".join([" | ".join(rows[0]), "-" * 50, *[" | ".join(r) for r in rows[1:]]]) if rows else ""


# DOCX


@dataclass
class Paragraph:
    text: str
    style: str = "Normal"

    @property
    def heading(self) -> bool:
        return self.style.startswith("Heading") or self.style == "Title"

    @property
    def level(self) -> int | None:
        found = re.fullmatch(r"Heading (\d+)", self.style)
        return int(found[1]) if found else None

    @property
    def listed(self) -> bool:
        return self.style.startswith("List")


def _runs(element: ElementTree.Element) -> str:
    out = []
    for node in element.iter():
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}tab":
            out.append("\t")
        elif node.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def read_docx(data: bytes) -> list[Paragraph | list[list[str]]]:
    """Paragraphs and tables (rows of cells, empty rows dropped) of the body in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                if name is not None:
                    shown = name.get(f"{_W}val", "")
                    names[style.get(f"{_W}styleId")] = shown[:1].upper() + shown[1:]
    out: list[Paragraph | list[list[str]]] = []
    for element in body if body is not None else ():
        if element.tag == f"{_W}p":
            style = element.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else None
            out.append(Paragraph(_runs(element).strip(), names.get(key, re.sub(r"(?<=[a-z])(?=\d)", " ", key) if key else "Normal")))
        elif element.tag == f"{_W}tbl":
            rows = [[_runs(cell).strip() for cell in row.findall(f"{_W}tc")] for row in element.findall(f"{_W}tr")]
            out.append([r for r in rows if any(r)])
    return out


def structured_text(parts: list[Paragraph | list[list[str]]]) -> str:
    """The document as text: # for headings (## without a level), bullets for lists, a mark for tables."""
    out = []
    for part in parts:
        if isinstance(part, list):
            out.append("[TABLE]")
        elif part.text:
            out.append(f"{'#' * min(part.level or 2, 6)} {part.text}" if part.heading else f"• {part.text}" if part.listed else part.text)
    return "\n".join(out)


def docx_blocks(data: bytes) -> list[Block]:
    """One page, one block: a region for each heading, run of content and table."""
    parts = read_docx(data)
    regions: list[Region] = []
    held: list[str] = []

    def close() -> None:
        if held:
            regions.append(Region("content", "\n".join(held), 0.8))
            held.clear()

    for part in parts:
        if isinstance(part, list):
            close()
        elif part.heading and part.text:
            close()
            regions.append(Region("heading", part.text, 1.0, {"level": part.level or 0}))
        elif part.text:
            held.append(f"• {part.text}" if part.listed else part.text)
    close()
    tables = [p for p in parts if isinstance(p, list) and p]
    regions += [Region("table", table_text(t), 0.9, {"total_rows": len(t), "columns": len(t[0])}) for t in tables]
    if not regions:
        regions = [Region("fallback", structured_text(parts), 0.8)]
    paragraphs = [p for p in parts if isinstance(p, Paragraph) and p.text]
    stats = {
        "paragraph_count": len(paragraphs),
        "table_count": len(tables),
        "word_count": sum(len(p.text.split()) for p in paragraphs),
        "has_headings": any(p.heading for p in paragraphs),
        "has_lists": any(p.listed for p in paragraphs),
    }
    return [Block(1, "document", "Document Content", regions, stats)]


# XLSX


@dataclass
class Cell:
    row: int
    column: int
    value: str
    kind: str
    formula: str = ""

    @property
    def coordinate(self) -> str:
        return f"{column_name(self.column)}{self.row}"


def column_name(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_number(name: str) -> int:
    out = 0
    for letter in name:
        out = out * 26 + ord(letter) - 64
    return out


@dataclass
class Sheet:
    name: str
    cells: list[Cell]

    def rows(self) -> list[list[str]]:
        """Rows from the first used column to the last; empty rows dropped; formulas as text."""
        if not self.cells:
            return []
        first, last = min(c.column for c in self.cells), max(c.column for c in self.cells)
        by_row: dict[int, list[str]] = {}
        for c in self.cells:
            by_row.setdefault(c.row, [""] * (last - first + 1))[c.column - first] = c.formula or c.value
        return [r for _, r in sorted(by_row.items()) if any(v.strip() for v in r)]

    @property
    def formulas(self) -> list[Cell]:
        return [c for c in self.cells if c.formula]


def read_xlsx(data: bytes) -> tuple[list[Sheet], int]:
    """Sheets in workbook order and the number of named ranges."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        target = {x.get("Id"): x.get("Target", "") for x in links}
        sheets = []
        for entry in book.iter(f"{_S}sheet"):
            path = target.get(entry.get(f"{_R}id"), "")
            path = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
            sheets.append(Sheet(entry.get("name", ""), _cells(ElementTree.fromstring(archive.read(path)), strings)))
        return sheets, sum(1 for _ in book.iter(f"{_S}definedName"))


def _cells(root: ElementTree.Element, strings: list[str]) -> list[Cell]:
    out, row_number = [], 0
    for row in root.iter(f"{_S}row"):
        row_number = int(row.get("r", row_number + 1))
        column = 0
        for cell in row.findall(f"{_S}c"):
            place = re.fullmatch(r"([A-Z]+)\d+", cell.get("r", ""))
            column = column_number(place[1]) if place else column + 1
            kind, formula = cell.get("t", "n"), cell.findtext(f"{_S}f")
            value = cell.findtext(f"{_S}v") or ""
            if kind == "s":
                value = strings[int(value)] if value else ""
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
            elif kind == "b":
                value = "True" if value == "1" else "False"
            if value or formula:
                out.append(Cell(row_number, column, value, "f" if formula else kind, f"={formula}" if formula else ""))
    return out


def _first(lines: list[str], most: int, what: str) -> str:
    more = [f"... ({len(lines) - most} more {what})"] if len(lines) > most else []
    return "\n".join([*lines[:most], *more])


def sheet_regions(sheet: Sheet) -> list[Region]:
    """Empty, or a table (two rows, two headers) or the sheet's data, then its formulas."""
    rows = sheet.rows()
    if len(rows) * max((len(r) for r in rows), default=0) <= 1:
        return [Region("empty", f"Empty worksheet: {sheet.name}", 1.0)]
    out = []
    lines = [" | ".join(r) for r in rows]
    if len(rows) >= 2 and sum(bool(v.strip()) for v in rows[0]) >= 2:
        out.append(Region("table", "\n".join([lines[0], "-" * 50, _first(lines[1:], TABLE_ROWS, "rows")]), 0.9, {"rows": len(rows) - 1, "columns": len(rows[0])}))
    else:
        out.append(Region("sheet_data", _first(lines, SHEET_ROWS, "rows"), 0.8, {"rows": len(rows)}))
    if sheet.formulas:
        out.append(Region("formulas", _first([f"{c.coordinate}: {c.formula}" for c in sheet.formulas], FORMULAS, "formulas"), 0.7, {"formulas": len(sheet.formulas)}))
    return out


def xlsx_blocks(data: bytes) -> list[Block]:
    """A page and a block for each sheet, with the workbook's totals."""
    sheets, named = read_xlsx(data)
    totals = {"total_sheets": len(sheets), "total_cells": sum(len(s.cells) for s in sheets), "total_formulas": sum(len(s.formulas) for s in sheets), "named_ranges": named}
    return [Block(k, "worksheet", s.name, sheet_regions(s), totals | {"cells": len(s.cells), "formulas": len(s.formulas)}) for k, s in enumerate(sheets, 1)]


READERS = {"docx": docx_blocks, "xlsx": xlsx_blocks}
SCHEMA = "document_id string, page_number int, block_idx int, label string, title string, region_idx int, kind string, raw_text string, confidence double, metadata map<string,string>, error string"
_ARROW = pa.schema(
    [("document_id", pa.string()), ("page_number", pa.int32()), ("block_idx", pa.int32()), ("label", pa.string()), ("title", pa.string()), ("region_idx", pa.int32()), ("kind", pa.string()), ("raw_text", pa.string()), ("confidence", pa.float64()), ("metadata", pa.map_(pa.string(), pa.string())), ("error", pa.string())]
)


def office_regions(documents: DataFrame) -> DataFrame:
    """Regions of (document_id, kind ``docx`` or ``xlsx``, raw_bytes) as rows, block metadata with each."""

    def work(document_id: str, kind: str, data: bytes) -> list[tuple]:
        rows: list[tuple] = []
        try:
            for k, block in enumerate(READERS[kind](data)):
                for i, r in enumerate(block.regions):
                    shown = [(n, str(v)) for n, v in {**block.metadata, **r.metadata}.items()]
                    rows.append((document_id, block.page, k, block.label, block.title, i, r.kind, r.text, r.confidence, shown, None))
        except Exception as error:  # noqa: BLE001  one bad file must not fail the job
            rows = [(document_id, *[None] * 9, f"{type(error).__name__}: {error}"[:300])]
        return rows

    return map_tuples(documents.select("document_id", "kind", "raw_bytes"), work, SCHEMA, _ARROW)
