"""Writes small ``.xlsx`` files for tests with the standard library."""

from __future__ import annotations

import datetime as dt
import os
import zipfile
from xml.sax.saxutils import escape

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
DATE_STYLE = 1


def _letters(column: int) -> str:
    text = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        text = chr(65 + rest) + text
    return text


def _cell(row: int, column: int, value, shared: list[str]) -> str:
    at = f'r="{_letters(column)}{row}"'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c {at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, dt.datetime):
        serial = (value - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
        return f'<c {at} s="{DATE_STYLE}"><v>{serial!r}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c {at}><v>{value!r}</v></c>'
    if value.startswith("inline:"):
        return f'<c {at} t="inlineStr"><is><t>{escape(value[7:])}</t></is></c>'
    if value.startswith("#"):
        return f'<c {at} t="e"><v>{value}</v></c>'
    shared.append(value)
    return f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'


def write_workbook(path: str, sheets: dict[str, list[list]], modified: float | None = None) -> str:
    shared: list[str] = []
    bodies = []
    for rows in sheets.values():
        body = "".join(
            f'<row r="{i}">' + "".join(_cell(i, j, v, shared) for j, v in enumerate(row)) + "</row>"
            for i, row in enumerate(rows, start=1)
            if row
        )
        bodies.append(f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, start=1))
    links = "".join(
        f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"'
        f' Target="worksheets/sheet{i}.xml"/>'
        for i in range(1, len(sheets) + 1)
    )
    strings = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
    styles = (
        f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy\\ hh:mm"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    )
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f"<workbook {MAIN} {RELS}><sheets>{names}</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        book.writestr("xl/styles.xml", styles)
        for i, body in enumerate(bodies, start=1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", body)
    if modified is not None:
        os.utime(path, (modified, modified))
    return path
