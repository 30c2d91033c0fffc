"""Workbooks as a sink: rows of cells in, one ``.xlsx`` file per book out, all files of a job or none.

``save_books`` cuts the sheets of all books into parts of ``PART_ROWS`` rows. Tasks write the parts side by side as
deflated XML, so a large book is many tasks' work; then one task per book copies the bytes of its parts into
the file, without reading rows again. Files and parts lie below working folders until every task is done; then
the files move to their names. A task that is repeated writes a new file, so what a lost executor left is never published.
"""

from __future__ import annotations

import datetime as dt
import posixpath
import re
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from floorledger import schema as S
from floorledger.session import cut_lineage

BOOK_ROWS = "book string, sheet_idx int, sheet string, ord long, row_idx long, cells array<struct<kind: string, value: string>>"
CELLS = "array<struct<kind: string, value: string>>"
PARTS = f"book string, sheet_idx int, sheet string, block long, part long, head {CELLS}, draft string, size long, packed long, crc long"
PART_KEYS = ["book", "sheet_idx", "sheet", "block", "part"]
TEXT, NUMBER, TRUTH, MOMENT = "s", "n", "b", "d"
#: Row numbers of a sheet that one part holds.
PART_ROWS = 1 << 14
CHUNK = 1 << 20
#: Level 6 took 1.2 us a cell, level 3 0.3 us.
LEVEL = 3
# Fixed values of the public OOXML format.
MOST_ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MEDIA = "application/vnd.openxmlformats-officedocument.spreadsheetml"
EPOCH = dt.datetime(1899, 12, 30)
#: The place in a workbook that says which sheets go on another one, how many rows come before theirs, and where parts begin.
CONTINUED, CONTINUED_URI = "urn:floorledger:continued", "{6B1F3C52-6C0D-4E0B-9E0C-5A3B0D7F2A11}"
XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")

_SPECIAL = re.compile("[&<>\r]|" + _FORBIDDEN.pattern)


@lru_cache(maxsize=1 << 14)
def letters(column: int) -> str:
    """A, B, ... Z, AA, ... for column numbers from 0."""
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(ord("A") + rest) + out
    return out


def cell_xml(at: str, kind: str, value: str) -> str:
    if kind == NUMBER:
        return f'<c r="{at}"><v>{value}</v></c>'
    if kind == TRUTH:
        return f'<c r="{at}" t="b"><v>{int(value == "true")}</v></c>'
    if kind == MOMENT:
        serial = (dt.datetime.fromisoformat(value) - EPOCH) / dt.timedelta(days=1)
        return f'<c r="{at}" s="1"><v>{serial!r}</v></c>'
    if _SPECIAL.search(value):
        value = escape(_FORBIDDEN.sub("�", value), {"\r": "&#13;"})
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{value}</t></is></c>'


def row_xml(row: int, cells: Iterable[tuple[str, str | None]]) -> str:
    body = "".join([cell_xml(f"{letters(k)}{row + 1}", kind, value) for k, (kind, value) in enumerate(cells) if value is not None])
    return f'<row r="{row + 1}">{body}</row>'


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def join_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two texts one behind the other, from theirs and the second's size: ``first`` goes through ``size`` zero bytes."""
    step = [0xEDB88320, *[1 << k for k in range(31)]]  # one zero bit
    for _ in range(3):
        step = [_times(step, row) for row in step]
    while size:
        if size & 1:
            first = _times(step, first)
        step = [_times(step, row) for row in step]
        size >>= 1
    return first ^ second


OPENING, CLOSING = f'{XML}<worksheet xmlns="{MAIN}"><sheetData>'.encode(), b"</sheetData></worksheet>"


class Book:
    """One workbook, written as a stream: sheets and rows in order, or sheets in parts; nothing held but sheet names."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []
        self.sheet = self.part = None
        self.rows = self.shift = self.first = 0
        self.head: list | None = None
        #: number of a sheet -> number of the one it goes on, rows before its own
        self.continued: dict[int, tuple[int, int]] = {}
        #: number of a sheet -> its CRC, and where in its deflated bytes each part is, with its size and CRC
        self.index: dict[int, tuple[int, list[tuple[int, int, int]]]] = {}

    def _name(self, name: str, shift: int) -> str:
        """Take a name for the next sheet; its place among the parts."""
        self._end_sheet()
        plain = re.sub(r"[\[\]:*?/\\]", " ", name) or "Hoja"
        taken = {n.lower() for n in self.names}
        unique, k = plain[: S.SHEET_NAME_LIMIT], 2
        while unique.lower() in taken:
            mark = f" ({k})"
            unique, k = plain[: S.SHEET_NAME_LIMIT - len(mark)] + mark, k + 1
        self.names.append(unique)
        if shift:
            self.continued[len(self.names)] = (self.first, shift)
        else:
            self.first = len(self.names)
        return f"xl/worksheets/sheet{len(self.names)}.xml"

    def _open(self, name: str, shift: int = 0) -> None:
        self.part = self.zip.open(self._name(name, shift), "w", force_zip64=True)
        self.part.write(OPENING)
        self.shift, self.rows = shift, 0

    def _end_sheet(self) -> None:
        if self.part:
            self.part.write(CLOSING)
            self.part.close()
            self.part = None

    def add(self, sheet: str, row: int | None, cells: list[tuple[str, str | None]]) -> None:
        """Add a row to ``sheet``, rows in ascending order. A full sheet goes on in another one below the same first row."""
        if sheet != self.sheet:
            self._open(sheet)
            self.sheet, self.head = sheet, cells
        at = self.rows if row is None else row - self.shift
        if at >= MOST_ROWS:
            self._open(sheet, self.shift + at - 1)
            self._row(0, self.head)
            at = 1
        self._row(at, cells)

    def _row(self, row: int, cells: list[tuple[str, str | None]]) -> None:
        self.part.write(row_xml(row, cells).encode())
        self.rows = row + 1

    def add_parts(self, sheet: str, shift: int, head: list[tuple[str, str | None]], parts: list[dict], read) -> None:
        """Add a sheet, or with ``shift`` one that goes on the last, from deflated parts of its rows, whose bytes ``read`` gives."""
        info = zipfile.ZipInfo(self._name(sheet, shift), time.localtime()[:6])
        info.compress_type = zipfile.ZIP_DEFLATED
        opening = OPENING + (row_xml(0, head).encode() if shift else b"")
        ends = [pack(opening, zlib.Z_FULL_FLUSH), pack(CLOSING, zlib.Z_FINISH)]
        crc, size, packed, index = zlib.crc32(opening), len(opening), len(ends[0]), []
        for p in parts:
            index.append((packed, p["packed"], p["crc"]))
            crc, size, packed = join_crc(crc, p["crc"], p["size"]), size + p["size"], packed + p["packed"]
        info.CRC, info.file_size, info.compress_size = join_crc(crc, zlib.crc32(CLOSING), len(CLOSING)), size + len(CLOSING), packed + len(ends[1])
        self.index[len(self.names)] = info.CRC, index
        file = self.zip.fp
        info.header_offset = file.tell()
        file.write(info.FileHeader())
        file.write(ends[0])
        for p in parts:
            for data in read(p["draft"]):
                file.write(data)
        file.write(ends[1])
        self.zip.filelist.append(info)
        self.zip.NameToInfo[info.filename] = info
        self.zip.start_dir = file.tell()

    def close(self) -> None:
        self._end_sheet()
        many = range(1, len(self.names) + 1)
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(many, self.names, strict=True))
        links = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in many)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{MEDIA}.worksheet+xml"/>' for k in many)
        more = ""
        for k in sorted({*self.continued, *self.index}):
            of, shift = self.continued.get(k, (k, 0))
            crc, index = self.index.get(k, ("", []))
            places = "".join(f'<f:rows at="{at}" packed="{packed}" crc="{own}"/>' for at, packed, own in index)
            more += f'<f:part sheetId="{k}" of="{of}" before="{shift}" crc="{crc}">{places}</f:part>'
        more = f'<extLst><ext uri="{CONTINUED_URI}" xmlns:f="{CONTINUED}">{more}</ext></extLst>' if more else ""
        last = len(self.names) + 1
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{sheets}</sheets>{more}</workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{links}'
            f'<Relationship Id="rId{last}" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><numFmts count="1"><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd\\ hh:mm:ss"/>'
            '</numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
            '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="170" applyNumberFormat="1"/>'
            "</cellXfs></styleSheet>",
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" '
            'Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" '
            'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{MEDIA}.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="{MEDIA}.styles+xml"/>{kinds}</Types>',
        }
        for name, text in parts.items():
            self.zip.writestr(name, XML + text)
        self.zip.close()


def file_name(book: str) -> str:
    """The file of a book: its name without separators, with the ending."""
    plain = re.sub(r'[/\\:*?"<>|\x00-\x1f]', "-", book).strip(". ") or "libro"
    return plain if plain.lower().endswith(".xlsx") else f"{plain}.xlsx"


def place(path: str):
    """(file system, path) of a folder name or URI that tasks can reach."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def pack(data: bytes, how: int) -> bytes:
    """Deflated without a frame; anything but ``Z_FINISH`` lets another piece follow."""
    packer = zlib.compressobj(LEVEL, wbits=-zlib.MAX_WBITS)
    return packer.compress(data) + packer.flush(how)


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Key, row number and (kind, value) pairs of each row; cells are taken out of Arrow column by column."""
    cells = batch.column("cells")
    lengths = [n or 0 for n in cells.value_lengths().to_pylist()]
    kinds, values = (c.to_numpy(zero_copy_only=False).tolist() for c in cells.flatten().flatten())
    keys = zip(*[batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in PART_KEYS], strict=True)
    at = 0
    for key, row, n in zip(keys, batch.column("row_idx").to_pylist(), lengths, strict=True):
        yield key, row, [*zip(kinds[at : at + n], values[at : at + n], strict=True)]
        at += n


def _write_parts(batches: Iterator[pa.RecordBatch], folder: str, work: str, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> a file for each part, deflated XML that others can follow; a row of ``PARTS`` for each file."""
    files, base = place(folder)
    fields = pa.schema(
        [("book", pa.string()), ("sheet_idx", pa.int32()), ("sheet", pa.string()), ("block", pa.int64()), ("part", pa.int64()),
         ("head", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))), ("draft", pa.string()),
         ("size", pa.int64()), ("packed", pa.int64()), ("crc", pa.int64())]
    )
    rows = (row for batch in batches for row in _rows_of(batch))
    for key, group in groupby(rows, key=lambda row: row[0]):
        draft = f"{work}/{uuid.uuid4().hex}"
        files.create_dir(posixpath.join(base, work), recursive=True)
        packer, shift, head = zlib.compressobj(LEVEL, wbits=-zlib.MAX_WBITS), key[3] * (most - 1), None
        size = packed = crc = held = 0
        texts: list[str] = []
        with files.open_output_stream(posixpath.join(base, draft)) as stream:

            def flush(how: int) -> None:
                nonlocal size, packed, crc, held
                data = "".join(texts).encode()
                out = packer.compress(data) + (packer.flush(how) if how else b"")
                stream.write(out)
                size, packed, crc, held = size + len(data), packed + len(out), zlib.crc32(data, crc), 0
                texts.clear()

            for _, row, cells in group:
                head = cells if head is None else head
                texts.append(row_xml(row - shift, cells))
                held += len(texts[-1])
                if held > CHUNK:
                    flush(0)
            flush(zlib.Z_FULL_FLUSH)
        head = [{"kind": kind, "value": value} for kind, value in head]
        found = dict(zip(PART_KEYS, key, strict=True)) | {"head": head, "draft": draft, "size": size, "packed": packed, "crc": crc}
        yield pa.RecordBatch.from_pylist([found], schema=fields)


class BookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, most: int):
        self.path, self.most = path.rstrip("/"), most
        self.work = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = place(self.path)
        done: list[tuple[str, str]] = []

        def read(draft: str) -> Iterator[bytes]:
            with files.open_input_stream(posixpath.join(base, draft)) as stream:
                while data := stream.read(CHUNK):
                    yield data

        rows = (row for batch in iterator for row in batch.to_pylist())
        for name, parts in groupby(rows, key=lambda row: row["book"]):
            done.append((file_name(name), f"{self.work}/{uuid.uuid4().hex}.xlsx"))
            files.create_dir(posixpath.join(base, self.work), recursive=True)
            with files.open_output_stream(posixpath.join(base, done[-1][1])) as stream:
                book = Book(stream)
                last = head = None
                for (number, sheet, block), some in groupby(parts, key=lambda row: (row["sheet_idx"], row["sheet"], row["block"])):
                    some = list(some)
                    if (number, sheet) != last:
                        last, head = (number, sheet), [(c["kind"], c["value"]) for c in some[0]["head"]]
                        if block:  # nothing is in the first rows
                            book.add_parts(sheet, 0, head, [], read)
                    book.add_parts(sheet, block * (self.most - 1), head, some, read)
                book.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = place(self.path)
        for final, draft in (f for m in messages if m for f in m.files):
            files.move(posixpath.join(base, draft), posixpath.join(base, final))
        _delete(self.path, self.work)

    def abort(self, messages: list[Written | None]) -> None:
        _delete(self.path, self.work)


class BookSink(DataSource):
    """``df.write.format("books").mode("append").save(folder)`` for frames of ``PARTS``, one book after the other in each task, parts in order."""

    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return PARTS

    def writer(self, schema: T.StructType, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"], int(self.options["most"]))


def number_rows(rows: DataFrame) -> DataFrame:
    """Fill ``row_idx`` where it is null: the place behind the row before, in the order of ``ord``."""
    if rows.where("row_idx IS NULL").isEmpty():  # reads one column, and ends at the first row without a number
        return rows
    sheet = Window.partitionBy("book", "sheet_idx", "sheet").orderBy("ord")
    counted = rows.withColumn("__n", F.row_number().over(sheet) - F.lit(1))
    given = F.last(F.col("row_idx") - F.col("__n"), ignorenulls=True).over(sheet.rowsBetween(Window.unboundedPreceding, 0))
    placed = F.coalesce("row_idx", F.col("__n") + F.coalesce(given, F.lit(0)))
    return counted.withColumn("__at", placed).withColumn("row_idx", F.col("__at")).drop("__n", "__at")


def save_books(rows: DataFrame, folder: str) -> None:
    """Write ``rows`` (``BOOK_ROWS``) as workbooks below ``folder``; files of the same names are replaced.

    ``row_idx`` is a row's place in its sheet, from 0; where it is null, the next one in the order of ``ord``. Rows
    of a part meet in one task, sorted there by Spark with spilling, and stream into a file; those of a book never do.
    A sheet of more than ``MOST_ROWS`` rows goes on in further sheets, as the workbook itself notes for ``read_workbooks``.
    """
    spark = rows.sparkSession
    spark.dataSource.register(BookSink)
    most, work = MOST_ROWS, f"_parts-{uuid.uuid4().hex}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    after = "greatest(row_idx - 1, 0L)"
    keyed = number_rows(rows.select(*T.StructType.fromDDL(BOOK_ROWS).names)).withColumns(
        {"block": F.expr(f"{after} div {most - 1}L"), "part": F.expr(f"{after} % {most - 1}L div {PART_ROWS}L")}
    )
    # dealt by number: a part is small to shuffle and slow to write
    dealt = keyed.repartition(tasks, *PART_KEYS).sortWithinPartitions(*PART_KEYS, "row_idx", "ord")
    try:
        parts = cut_lineage(dealt.mapInArrow(lambda batches: _write_parts(batches, folder, work, most), PARTS))
        ordered = parts.repartition(tasks, "book").sortWithinPartitions(*PART_KEYS)
        ordered.write.format("books").option("most", most).mode("append").save(folder)
    finally:
        _delete(folder, work)


def _delete(folder: str, name: str) -> None:
    from pyarrow import fs

    files, base = place(folder)
    work = posixpath.join(base, name)
    if files.get_file_info(work).type == fs.FileType.Directory:
        files.delete_dir(work)


def cell(column: Column, kind: T.DataType) -> Column:
    """A value as (kind, text)."""
    if isinstance(kind, T.BooleanType):
        mark = TRUTH
    elif isinstance(kind, T.NumericType):
        mark = NUMBER
        column = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column) if isinstance(kind, (T.DoubleType, T.FloatType)) else column
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        mark = MOMENT
    else:
        mark = TEXT
    return F.struct(F.lit(mark).alias("kind"), column.cast("string").alias("value"))


def sheet_rows(frame: DataFrame, book: str, number: int, sheet: str) -> DataFrame:
    """A frame as one sheet: a row of column names, then the frame's rows in its order."""
    spark = frame.sparkSession
    same = [F.lit(book).alias("book"), F.lit(number).alias("sheet_idx"), F.lit(sheet).alias("sheet")]
    names = F.array(*[F.struct(F.lit(TEXT).alias("kind"), F.lit(c).alias("value")) for c in frame.columns])
    none = F.lit(None).cast("long").alias("row_idx")
    head = spark.range(1).select(*same, F.lit(0).cast("long").alias("ord"), none, names.alias("cells"))
    cells = F.array(*[cell(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in frame.schema])
    # ids ascend over the partitions of a sorted frame; the writer numbers the rows without gaps
    rows = frame.select(*same, (F.monotonically_increasing_id() + 1).alias("ord"), none, cells.alias("cells"))
    return head.unionByName(rows)


def save_bundles(bundles: dict[str, dict[str, DataFrame]], folder: str) -> None:
    """One workbook per bundle of reports, its reports as sheets in bundle order; a report without columns has no sheet."""
    frames = [
        sheet_rows(report, book, number, name)
        for book, reports in bundles.items()
        for number, (name, report) in enumerate(reports.items())
        if report.columns
    ]
    if not frames:
        return
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    save_books(rows, folder)
