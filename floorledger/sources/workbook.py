"""Decoder for one ``.xlsx`` workbook: bytes in, sheet rows of text cells out.

It runs inside ``mapInPandas``, one workbook at a time, reads each
sheet as a stream of rows and emits text only: dates become ISO text, whole numbers lose their ``.0``,
empty cells and error cells become null.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import unescape

# Fixed values of the public OOXML format.
BUILT_IN_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCH_1900 = dt.datetime(1899, 12, 30)
EPOCH_1904 = dt.datetime(1904, 1, 1)

# The marks of ``books`` for sheets that go on another one and for the parts that it wrote, and the form of their rows.
CONTINUED_PART, CONTINUED_ROWS = "{urn:floorledger:continued}part", "{urn:floorledger:continued}rows"
_WRITTEN = re.compile(r'<row r="(\d+)">|<c r="([A-Z]+)\d+"(?: t="(inlineStr|b)"| s="(1)")?><(?:is><t xml:space="preserve"|v)>([^<]*)<')

_QUOTED = re.compile(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|_.|\*.', re.IGNORECASE)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text_of(node: ET.Element) -> str:
    """Text of a string item: its ``t`` parts, without phonetic hints."""
    found = []
    for child in node:
        name = _local(child.tag)
        if name == "t":
            found.append(child.text or "")
        elif name == "r":
            found.extend(t.text or "" for t in child if _local(t.tag) == "t")
    return "".join(found)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in ET.iterparse(stream):
            if _local(node.tag) == "si":
                strings.append(_text_of(node))
                node.clear()
    return strings


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Style numbers whose number format shows a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    dates = set(BUILT_IN_DATE_FORMATS)
    for node in root.iter():
        if _local(node.tag) == "numFmt":
            code = _QUOTED.sub("", node.get("formatCode", "").split(";")[0])
            if re.search(r"[dmhysDMHYS]", code) and "General" not in code:
                dates.add(int(node.get("numFmtId")))
            else:
                dates.discard(int(node.get("numFmtId")))
    styles: set[int] = set()
    for node in root:
        if _local(node.tag) == "cellXfs":
            for i, xf in enumerate(node):
                if int(xf.get("numFmtId", "0")) in dates:
                    styles.add(i)
    return styles


@dataclass(frozen=True)
class Sheet:
    """A worksheet; ``on`` is the number of the sheet that it goes on, if any, and ``before`` the rows before its own.

    ``index`` has where in the deflated bytes each part of the rows is, its size and CRC, if the sheet still has ``crc``.
    """

    number: int
    name: str
    part: str
    on: int | None = None
    before: int = 0
    crc: int | None = None
    index: tuple[tuple[int, int, int], ...] = ()


def _sheets(book: zipfile.ZipFile) -> tuple[list[Sheet], dt.datetime]:
    """Every worksheet in tab order, and the date epoch."""
    targets = {}
    for node in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if node.get("Type", "").endswith("/worksheet"):
            target = node.get("Target", "")
            part = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
            targets[node.get("Id")] = posixpath.normpath(part)
    found, marks, epoch = [], {}, EPOCH_1900
    for node in ET.fromstring(book.read("xl/workbook.xml")).iter():
        name = _local(node.tag)
        if name == "workbookPr" and node.get("date1904", "0") in ("1", "true"):
            epoch = EPOCH_1904
        elif name == "sheet":
            relation = next((v for k, v in node.attrib.items() if _local(k) == "id"), None)
            if relation in targets:
                found.append((node.get("sheetId"), node.get("name", ""), targets[relation]))
        elif node.tag == CONTINUED_PART:
            marks[node.get("sheetId")] = node
    numbers = {key: k for k, (key, _, _) in enumerate(found)}
    sheets = []
    for k, (key, name, part) in enumerate(found):
        sheet, mark = Sheet(k, name, part), marks.get(key)
        if mark is not None:
            before, on = int(mark.get("before")), numbers.get(mark.get("of"))
            index = tuple(tuple(int(rows.get(x)) for x in ("at", "packed", "crc")) for rows in mark.iter(CONTINUED_ROWS))
            sheet = replace(sheet, crc=int(mark.get("crc")) if mark.get("crc") else None, index=index)
            if before and on is not None:
                sheet = replace(sheet, on=on, before=before)
        sheets.append(sheet)
    return sheets, epoch


@lru_cache(maxsize=1 << 14)
def _column_number(reference: str) -> int:
    """Number from 0 of the column whose letters ``reference`` begins with."""
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number - 1


def _date_text(serial: float, epoch: dt.datetime) -> str | None:
    try:
        # The 1900 calendar counts a 29 February 1900 that never was.
        shift = 1 if epoch is EPOCH_1900 and 1 <= serial < 60 else 0
        moment = epoch + dt.timedelta(days=serial + shift)
    except OverflowError:
        return None
    moment = _to_millisecond(moment)
    if epoch is EPOCH_1900 and 0 <= serial < 1:
        return moment.strftime("%H:%M:%S")
    text = f"{moment:%Y-%m-%d %H:%M:%S}".rjust(19, "0")
    return text if not moment.microsecond else f"{text}.{moment.microsecond:06d}"


def _to_millisecond(moment: dt.datetime) -> dt.datetime:
    """Day fractions are not exact in binary; the format keeps milliseconds."""
    micro = round(moment.microsecond, -3)
    return moment.replace(microsecond=0) + dt.timedelta(microseconds=micro)


def _number_text(raw: str) -> str:
    number = float(raw)
    if number.is_integer() and abs(number) < 1e15:
        return str(int(number))
    return repr(number)


def _cell_text(cell: ET.Element, strings: list[str], dates: set[int], epoch: dt.datetime) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr" and len(cell) == 1 and len(cell[0]) == 1 and _local(cell[0].tag) == "is":  # one plain text
        return _text_of(cell[0]) or None
    value = inline = None
    for child in cell:
        name = _local(child.tag)
        if name == "v":
            value = child.text
        elif name == "is":
            inline = _text_of(child)
    if kind == "inlineStr":
        return inline or None
    if value is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value)] or None
    if kind == "str":
        return value or None
    if kind == "b":
        return "True" if value.strip() == "1" else "False"
    if kind == "d":
        return value.replace("T", " ")
    if int(cell.get("s", "0")) in dates:
        return _date_text(float(value), epoch)
    return _number_text(value)


def _row_cells(node: ET.Element, strings: list[str] | dict[int, str], dates: set[int], epoch: dt.datetime) -> list[str | None]:
    cells: list[str | None] = []
    for cell in node:
        if _local(cell.tag) != "c":
            continue
        reference = cell.get("r")
        column = _column_number(reference.rstrip("0123456789")) if reference else len(cells)
        if column == len(cells):
            cells.append(_cell_text(cell, strings, dates, epoch))
            continue
        cells.extend([None] * (column + 1 - len(cells)))
        cells[column] = _cell_text(cell, strings, dates, epoch)
    return cells


def _rows(
    stream, strings: list[str] | dict[int, str], dates: set[int], epoch: dt.datetime, position: int = -1
) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 0, cells) of each row that has any, after row ``position``; cleared once read, so memory stays flat."""
    holder = None
    for event, node in ET.iterparse(stream, events=("start", "end")):
        name = _local(node.tag)
        if event == "start":
            if name == "sheetData":
                holder = node
            continue
        if name != "row":
            continue
        position = int(node.get("r", position + 2)) - 1
        yield position, _row_cells(node, strings, dates, epoch)
        if holder is not None:
            holder.clear()


def _wanted(book: zipfile.ZipFile, sheet: str | None, on: bool = False) -> tuple[list[Sheet], dt.datetime]:
    """The named sheet, or the first one, with ``on`` followed by those that go on it, and the date epoch."""
    sheets, epoch = _sheets(book)
    wanted = [replace(s, before=0) for s in sheets if (s.number == 0 if sheet is None else s.name == sheet)][:1]
    if not wanted:
        raise LookupError("no such sheet" if sheets else "no sheets")
    if on:
        wanted += sorted((s for s in sheets if s.on == wanted[0].number), key=lambda s: s.before)
    return wanted, epoch


def _whole(rows: Iterator[tuple[int, list[str | None]]], before: int) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of a sheet by their place in the one that it goes on, without the first row, which is repeated there."""
    return ((row + before, cells) for row, cells in rows if row) if before else rows


def workbook_rows(content: bytes, sheet: str | None = None, on: bool = False) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet name, sheet number, row number, cells) of the named sheet, or of the first one.

    With ``on``, rows of the sheets that go on it follow under its name. Other sheets are not read, so damage
    in them does not matter.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        wanted, epoch = _wanted(book, sheet, on)
        strings, dates = _shared_strings(book), _date_styles(book)
        for part in wanted:
            with book.open(part.part) as stream:
                for row, cells in _whole(_rows(stream, strings, dates, epoch), part.before):
                    yield wanted[0].name, wanted[0].number, row, cells


def sheet_parts(file, sheet: str | None = None) -> list[dict]:
    """What is needed to read each part of a sheet that ``books`` wrote in parts; empty for any other workbook.

    Rows are not read. A sheet that was changed since has another CRC.
    """
    with zipfile.ZipFile(file) as book:
        wanted, epoch = _wanted(book, sheet, True)
        infos = [book.getinfo(w.part) for w in wanted]
        if any(w.crc != info.CRC for w, info in zip(wanted, infos, strict=True)):
            return []
        same = {"sheet": wanted[0].name, "sheet_idx": wanted[0].number, "dates": sorted(_date_styles(book)), "from_1904": epoch is EPOCH_1904}
        found = []
        for w, info in zip(wanted, infos, strict=True):
            file.seek(info.header_offset + 26)
            start = info.header_offset + 30 + sum(struct.unpack("<HH", file.read(4)))
            for at, packed, crc in w.index:
                found.append(same | {"before": w.before, "at": start + at, "packed": packed, "crc": crc, "first": not found})
        return found


def part_rows(file, at: int, packed: int, crc: int, before: int, dates: set[int], from_1904: bool) -> list[tuple[int, list[str | None]]]:
    """Rows of one part, taken from the form in which ``books`` writes them."""
    file.seek(at)
    data = zlib.decompressobj(wbits=-zlib.MAX_WBITS).decompress(file.read(packed))
    if zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("Bad CRC-32 for rows of a sheet")
    epoch = EPOCH_1904 if from_1904 else EPOCH_1900
    rows: list[tuple[int, list[str | None]]] = []
    cells: list[str | None] = []
    for row, column, kind, style, value in _WRITTEN.findall(data.decode()):
        if row:
            cells = []
            rows.append((int(row) - 1 + before, cells))
            continue
        if kind == "inlineStr":
            text = (unescape(value, {"&#13;": "\r"}) if "&" in value else value) or None
        elif kind:
            text = "True" if value == "1" else "False"
        elif style and 1 in dates:
            text = _date_text(float(value), epoch)
        else:
            text = _number_text(value)
        number = _column_number(column)
        if number > len(cells):
            cells.extend([None] * (number - len(cells)))
        cells.append(text)
    return rows


# --- large sheets in pieces ------------------------------------------------------------------------

ROWS, STRINGS = "rows", "strings"
PIECE_BYTES = 2 << 20
_PREFIX = rb"(?:[\w.\-]+:)?"
_ITEMS = {ROWS: b"row", STRINGS: b"si"}
_ROW_TAG = re.compile(rb"<" + _PREFIX + rb"row\b([^>]*)>")
_ROW_NUMBER = re.compile(rb"""(?<![\w:.\-])r\s*=\s*["'](\d+)["']""")
_STRING_USE = re.compile(rb"""(?<![\w:.\-])t\s*=\s*["']s["'][^>]*>.*?<""" + _PREFIX + rb"""v\b[^>]*>\s*(\d+)""", re.DOTALL)
_OTHER_CODE = re.compile(rb"""encoding\s*=\s*["'](?!utf-8|us-ascii)""", re.IGNORECASE)


@dataclass(frozen=True)
class Piece:
    """A part of a sheet or of the string table that is an XML text of its own.

    ``first`` is the row before its first row, or the number of its first string; ``before`` the rows before
    those of its sheet, if that goes on another one.
    """

    kind: str
    number: int
    first: int
    xml: bytes
    before: int = 0


def _cuttable(stream) -> bool:
    """Whether tags can be found by their text: no comments or CDATA, and a byte encoding that keeps ASCII."""
    last = b""
    while data := stream.read(1 << 20):
        if not last and (data[:2] in (b"\xff\xfe", b"\xfe\xff") or _OTHER_CODE.search(data[:200])):
            return False
        if b"<!" in last + data:
            return False
        last = data[-1:]
    return True


def _cut(stream, kind: str, size: int) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(tag of an item, items, whole XML text) of each piece: cut behind an item, with the tags around the items put back."""
    begin = re.compile(rb"<(" + _PREFIX + _ITEMS[kind] + rb")\b")
    head = close = tag = end = None
    held = b""
    while data := stream.read(size):
        held += data
        if head is None:
            found = begin.search(held)
            if not found:
                continue
            tag, head, held = found[1], held[: found.start()], held[found.start() :]
            opened = re.findall(rb"<([\w.\-:]+)(?:\s[^>]*[^>/]|\s*)?>", head)
            around = [t for t in opened if t.rsplit(b":", 1)[-1] in (b"worksheet", b"sheetData", b"sst")]
            close = b"".join(b"</" + t + b">" for t in reversed(around))
            end = b"</" + tag + b">"
        last = held.rfind(end)
        if last >= 0:
            last += len(end)
            yield tag, held[:last], head + held[:last] + close
            held = held[last:]
    if head is not None:  # what follows the items, or is left of a broken one, is read as it is
        yield tag, held, head + held


def workbook_pieces(
    content: bytes, sheet: str | None = None, size: int = PIECE_BYTES, on: bool = False
) -> tuple[dict, Iterator[Piece]] | None:
    """What is needed to read the sheet's rows, and its pieces and those of the string table; None if it cannot be cut.

    One pass inflates the parts and looks for tags by their text; XML is read from the pieces, anywhere. With
    ``on``, pieces of the sheets that go on it follow.
    """
    book = zipfile.ZipFile(io.BytesIO(content))
    wanted, epoch = _wanted(book, sheet, on)
    parts = [(ROWS, part.part, part.before) for part in wanted]
    if "xl/sharedStrings.xml" in book.namelist():
        parts.append((STRINGS, "xl/sharedStrings.xml", 0))
    for _, where, _ in parts:
        with book.open(where) as stream:
            if not _cuttable(stream):
                return None

    def pieces() -> Iterator[Piece]:
        numbers = {ROWS: 0, STRINGS: 0}
        for kind, where, before in parts:
            first = -1 if kind == ROWS else 0
            with book.open(where) as stream:
                for tag, items, xml in _cut(stream, kind, size):
                    yield Piece(kind, numbers[kind], first, xml, before)
                    first = _last_row(items, first) if kind == ROWS else first + _count(items, tag)
                    numbers[kind] += 1

    about = {"sheet": wanted[0].name, "sheet_idx": wanted[0].number, "dates": sorted(_date_styles(book)), "from_1904": epoch is EPOCH_1904}
    return about, pieces()


def _count(items: bytes, tag: bytes) -> int:
    """Opening tags; a < is never part of a text."""
    return sum(items.count(b"<" + tag + after) for after in (b">", b" ", b"/", b"\t", b"\n", b"\r"))


def _last_row(items: bytes, first: int) -> int:
    """The number of the last row: that of the last row with a number, and one for each row behind it."""
    for part in (items[-(1 << 16) :], items):
        behind = 0
        for tag in reversed(_ROW_TAG.findall(part)):
            given = _ROW_NUMBER.search(tag)
            if given:
                return int(given[1]) - 1 + behind
            behind += 1
    return first + behind


def string_uses(xml: bytes) -> list[int]:
    """The strings that the cells of a piece name, and perhaps some more."""
    return sorted({int(x) for x in _STRING_USE.findall(xml)})


def piece_rows(
    xml: bytes, first: int, strings: dict[int, str], dates: set[int], from_1904: bool, before: int = 0
) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of a piece; it is small, so its tree is built at once. Of a broken piece there are none."""
    epoch = EPOCH_1904 if from_1904 else EPOCH_1900
    root = ET.fromstring(xml)
    tag = next((node.tag for node in root.iter() if _local(node.tag) == "row"), "row")

    def rows() -> Iterator[tuple[int, list[str | None]]]:
        position = first
        for node in root.iter(tag):
            position = int(node.get("r", position + 2)) - 1
            yield position, _row_cells(node, strings, dates, epoch)

    return _whole(rows(), before)


def piece_strings(xml: bytes, first: int) -> Iterator[tuple[int, str]]:
    for _, node in ET.iterparse(io.BytesIO(xml)):
        if _local(node.tag) == "si":
            yield first, _text_of(node)
            first += 1
            node.clear()
