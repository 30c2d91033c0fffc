"""Raw grids: one row per sheet row, cells as text, header row still unknown."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger import schema as S
from floorledger.operators.lookups import lookup_join
from floorledger.session import checkpoint_folder, cut_lineage
from floorledger.sources.workbook import (
    PIECE_BYTES, ROWS, STRINGS, part_rows, piece_rows, piece_strings, sheet_parts, string_uses, workbook_pieces, workbook_rows,
)

WORKBOOK_GLOB = "*.[xX][lL][sS][xX]"
ROWS_PER_BATCH = 4096
#: Row groups of a staged grid: small, so that tasks share even one file.
STAGED_GROUP = 8 << 20
#: Workbooks of more bytes are cut into pieces.
LARGE_FILE = 8 << 20
END, WHOLE = "end", "whole"


def is_workbook_name(name: Column) -> Column:
    """Uploads are accepted by extension, in any case."""
    return F.lower(name).rlike(r"(?s)[^/]\.xlsx?$")


def _decode(batches: Iterator[pd.DataFrame], wanted: str | None) -> Iterator[pd.DataFrame]:
    columns = S.GRID_SCHEMA.names
    for files in batches:
        for path, modified, content in zip(files["path"], files["modificationTime"], files["content"]):
            pending: list[tuple] = []
            error = None
            try:
                for sheet, number, row, cells in workbook_rows(content, wanted, True):
                    pending.append((path, modified, sheet, number, row, cells, None))
                    if len(pending) >= ROWS_PER_BATCH:
                        yield pd.DataFrame(pending, columns=columns)
                        pending = []
            except LookupError as problem:
                error = str(problem)
            except Exception as problem:  # one unreadable upload must not end the job
                error = f"{type(problem).__name__}: {problem}"
            pending.append((path, modified, None, 0, -1, None, error))
            yield pd.DataFrame(pending, columns=columns)


def decode_workbooks(files: DataFrame, sheet: str | None = None, large: int = LARGE_FILE) -> DataFrame:
    """Grid of the first or named sheets of a ``binaryFile`` frame.

    A workbook of up to ``large`` bytes is decoded in one task, many workbooks side by side; a larger one is
    cut into pieces that all tasks decode (``decode_large``). After its rows each gives a row with
    ``row_idx = -1``, which holds its problem in ``error`` if it could not be read to the end: rows before a
    damaged place are in the grid and must be left out (see ``whole_sheets``). Sheets that ``books`` went on in
    other sheets are read as one; large ones that it wrote are decoded by the parts that it wrote (``decode_parts``).
    """
    columns = ["path", "modificationTime", "content"]
    small = files.where(F.col("length") <= large).select(*columns)
    grid = small.mapInPandas(lambda batches: _decode(batches, sheet), S.GRID_SCHEMA)
    big = files.where(F.col("length") > large)
    if big.select("path").isEmpty():  # from the list of files; contents are not read
        return grid
    parts = written_parts(big.select("path", "modificationTime"), sheet)
    if parts is not None:
        grid = grid.unionByName(decode_parts(parts))
        big = big.join(F.broadcast(parts.select("path").distinct()), "path", "left_anti")
        if big.select("path").isEmpty():
            return grid
    return grid.unionByName(decode_large(big.select(*columns), sheet))


PIECES = pa.schema(
    [
        ("path", pa.string()),
        ("modified", pa.timestamp("us", "UTC")),
        ("sheet", pa.string()),
        ("sheet_idx", pa.int32()),
        ("kind", pa.string()),
        ("piece", pa.int32()),
        ("first", pa.int64()),
        ("xml", pa.binary()),
        ("dates", pa.list_(pa.int32())),
        ("from_1904", pa.bool_()),
        ("error", pa.string()),
        ("before", pa.int64()),
    ]
)
PIECE_ROWS = (
    "path string, modified timestamp, sheet string, sheet_idx int, kind string, piece int, first long, xml binary, "
    "dates array<int>, from_1904 boolean, error string, before long"
)
GRID_ROWS = pa.schema(
    [
        *[PIECES.field(name) for name in ("path", "modified", "sheet", "sheet_idx")],
        ("row_idx", pa.int32()),
        ("cells", pa.list_(pa.string())),
        ("error", pa.string()),
    ]
)
STRING_ROWS = pa.schema([("path", pa.string()), ("id", pa.int64()), ("text", pa.string()), ("error", pa.string())])
USE_ROWS = pa.schema([("path", pa.string()), ("piece", pa.int32()), ("id", pa.int64())])
PART_ROWS = (
    "path string, modified timestamp, sheet string, sheet_idx int, dates array<int>, from_1904 boolean, "
    "before long, at long, packed long, crc long, first boolean"
)
PARTS = pa.schema(
    [PIECES.field(name) for name in ("path", "modified", "sheet", "sheet_idx", "dates", "from_1904", "before")]
    + [(name, pa.int64()) for name in ("at", "packed", "crc")]
    + [("first", pa.bool_())]
)
Batches = Iterator[pa.RecordBatch]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _reason(problem: Exception) -> str:
    return str(problem) if isinstance(problem, LookupError) else f"{type(problem).__name__}: {problem}"


def _cut_up(batches: Batches, wanted: str | None, size: int) -> Batches:
    for files in batches:
        for k in range(files.num_rows):  # one content at a time
            path, modified, content = (files.column(c)[k].as_py() for c in ("path", "modificationTime", "content"))
            same, error = {"path": path, "modified": modified}, None
            try:
                found = workbook_pieces(content, wanted, size, True)
                if found is None:  # not to be cut: decoded as a whole
                    yield _batch([same | {"kind": WHOLE, "xml": content}], PIECES)
                    continue
                about, pieces = found
                for p in pieces:
                    row = {"kind": p.kind, "piece": p.number, "first": p.first, "xml": p.xml, "before": p.before}
                    yield _batch([same | about | row], PIECES)
            except Exception as problem:  # one unreadable upload must not end the job
                error = _reason(problem)
            yield _batch([same | {"kind": END, "error": error}], PIECES)


def _decode_pieces(batches: Batches) -> Batches:
    for pieces in batches:
        for p in pieces.to_pylist():
            same = {"path": p["path"], "modified": p["modified"]}
            about = same | {"sheet": p["sheet"], "sheet_idx": p["sheet_idx"]}
            strings = {x["id"]: x["text"] for x in p["strings"] or []}
            rows: list[dict] = []
            try:
                for number, cells in piece_rows(p["xml"], p["first"], strings, set(p["dates"]), p["from_1904"], p["before"]):
                    rows.append(about | {"row_idx": number, "cells": cells})
            except Exception as problem:
                rows.append(same | {"sheet_idx": 0, "row_idx": -1, "error": _reason(problem)})
            yield _batch(rows, GRID_ROWS)


def _find_uses(batches: Batches) -> Batches:
    for pieces in batches:
        for p in pieces.to_pylist():
            yield _batch([{"path": p["path"], "piece": p["piece"], "id": k} for k in string_uses(p["xml"])], USE_ROWS)


def _read_strings(batches: Batches) -> Batches:
    for pieces in batches:
        for p in pieces.to_pylist():
            try:
                rows = [{"path": p["path"], "id": k, "text": text} for k, text in piece_strings(p["xml"], p["first"])]
            except Exception as problem:
                rows = [{"path": p["path"], "error": _reason(problem)}]
            yield _batch(rows, STRING_ROWS)


def decode_large(files: DataFrame, sheet: str | None = None, size: int = PIECE_BYTES) -> DataFrame:
    """The same grid for large workbooks: one task inflates each and cuts it between rows, all tasks decode the pieces.

    Pieces are staged in the shared folder. The string table is cut up too and becomes a table of its own;
    each piece is joined with the strings its cells name, so no task holds the whole table.
    """
    spark = files.sparkSession
    folder = f"{checkpoint_folder(spark)}/pieces-{uuid.uuid4().hex}"
    cut = files.mapInArrow(lambda batches: _cut_up(batches, sheet, size), PIECE_ROWS)
    # dealt by number, not by size: a piece is small to read and slow to decode
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut.repartition(tasks, "path", "kind", "piece").write.parquet(folder)
    pieces = spark.read.schema(PIECE_ROWS).parquet(folder)

    table = pieces.where(F.col("kind") == STRINGS).select("path", "first", "xml").mapInArrow(
        _read_strings, "path string, id long, text string, error string"
    )
    rows = pieces.where(F.col("kind") == ROWS)
    uses = rows.select("path", "piece", "xml").mapInArrow(_find_uses, "path string, piece int, id long")
    named = uses.join(table.where("error IS NULL").drop("error"), ["path", "id"])
    strings = named.groupBy("path", "piece").agg(F.collect_list(F.struct("id", "text")).alias("strings"))
    grid = rows.repartition(tasks, "path", "piece").join(strings, ["path", "piece"], "left").select("path", "modified", "sheet", "sheet_idx", "first", "before", "xml", "dates", "from_1904", "strings").mapInArrow(
        _decode_pieces, S.GRID_SCHEMA
    )
    whole = pieces.where(F.col("kind") == WHOLE).select("path", F.col("modified").alias("modificationTime"), F.col("xml").alias("content"))
    whole = whole.mapInPandas(lambda batches: _decode(batches, sheet), S.GRID_SCHEMA)
    none = {"sheet": F.lit(None).cast("string"), "sheet_idx": F.lit(0), "row_idx": F.lit(-1), "cells": F.lit(None).cast("array<string>")}
    ends = pieces.where(F.col("kind") == END).select("path", "modified", "error").withColumns(none).select(*S.GRID_SCHEMA.names)
    broken = table.where("error IS NOT NULL").select("path", "error").distinct()
    broken = broken.withColumns({"modified": F.lit(None).cast("timestamp")} | none).select(*S.GRID_SCHEMA.names)
    return grid.unionByName(whole).unionByName(ends).unionByName(broken)


def _file(path: str):
    """A file by its path in Spark, to be read at any place; an error if only Spark reaches it."""
    from pyarrow import fs

    local = re.match("(?:file:)?/+(?!/)", path)
    files, at = (fs.LocalFileSystem(), "/" + path[local.end() :]) if local else fs.FileSystem.from_uri(path)
    return files.open_input_file(at)


def _list_parts(batches: Batches, wanted: str | None) -> Batches:
    for files in batches:
        for f in files.to_pylist():
            same = {"path": f["path"], "modified": f["modificationTime"]}
            try:
                with _file(f["path"]) as file:
                    rows = [same | part for part in sheet_parts(file, wanted)]
            except Exception:  # what is wrong with it is told by the way for other workbooks
                continue
            yield _batch(rows, PARTS)


def written_parts(files: DataFrame, sheet: str | None = None) -> DataFrame | None:
    """A row for each part in which ``books`` wrote the wanted sheets of the ``files`` and those that go on them.

    Files are opened by tasks, which read a few kilobytes of each. None if there are no such files, or if only
    Spark reaches the folder.
    """
    parts = cut_lineage(files.mapInArrow(lambda batches: _list_parts(batches, sheet), PART_ROWS))
    return None if parts.isEmpty() else parts


def _grid_batch(p: dict, rows: list[tuple[int, list[str | None]]]) -> pa.RecordBatch:
    n, fields = len(rows), GRID_ROWS
    same = [pa.array([p[name]] * n, fields.field(name).type) for name in ("path", "modified", "sheet", "sheet_idx")]
    numbers = pa.array([row for row, _ in rows], pa.int32())
    cells = pa.array([cells for _, cells in rows], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([*same, numbers, cells, pa.nulls(n, pa.string())], schema=fields)


def _decode_part(batches: Batches) -> Batches:
    for parts in batches:
        for p in parts.to_pylist():
            error = None
            try:
                with _file(p["path"]) as file:
                    rows = part_rows(file, p["at"], p["packed"], p["crc"], p["before"], set(p["dates"]), p["from_1904"])
                for k in range(0, len(rows), ROWS_PER_BATCH):
                    yield _grid_batch(p, rows[k : k + ROWS_PER_BATCH])
            except Exception as problem:
                error = _reason(problem)
            if error or p["first"]:  # one end for each workbook
                end = {"path": p["path"], "modified": p["modified"], "sheet_idx": 0, "row_idx": -1, "error": error}
                yield _batch([end], GRID_ROWS)


def decode_parts(parts: DataFrame) -> DataFrame:
    """The grid of ``written_parts``: all tasks inflate and decode parts; none reads a sheet or workbook as a whole."""
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "path", "at").mapInArrow(_decode_part, S.GRID_SCHEMA)


def read_workbooks(
    spark: SparkSession, folder: str, recursive: bool = True, sheet: str | None = None, large: int = LARGE_FILE
) -> DataFrame:
    """Grid of the first or named sheets of all ``.xlsx`` files below ``folder``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", WORKBOOK_GLOB)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
    )
    return decode_workbooks(files, sheet, large)


def rejected_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path, error`` of the files below ``folder`` that no load reads. Contents are not read.

    Legacy ``.xls`` uploads are accepted by name, but no reader exists for them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    legacy = F.when(is_workbook_name(F.col("path")), "legacy .xls workbooks cannot be read").otherwise("not a workbook")
    return files.where(~F.lower("path").endswith(".xlsx")).select("path", legacy.alias("error"))


def stage_grid(grid: DataFrame, folder: str) -> DataFrame:
    """Write the grid once as parquet and read it back.

    Header detection and binding each scan the grid; staging keeps the workbooks from being decoded
    twice, lets the 30-row header search prune columns and row groups, and cuts the lineage. Files are cut into
    small row groups, which Spark deals evenly when it reads them, so cleaning does not run in as few tasks as
    there were workbooks, and the grid is not shuffled.
    """
    grid.write.mode("overwrite").option("parquet.block.size", STAGED_GROUP).parquet(folder)
    return grid.sparkSession.read.schema(S.GRID_SCHEMA).parquet(folder)


def pick_sheet(grid: DataFrame, sheet: str | None = None) -> DataFrame:
    """The named sheet, or the first one of each workbook."""
    readable = grid.where(F.col("row_idx") >= 0)
    return readable.where(F.col("sheet_idx") == 0 if sheet is None else F.col("sheet") == sheet)


def unreadable(grid: DataFrame) -> DataFrame:
    """Workbooks that could not be decoded to the end."""
    return grid.where((F.col("row_idx") < 0) & F.col("error").isNotNull()).select("path", "error")


def whole_sheets(grid: DataFrame, bad: DataFrame, sheet: str | None = None) -> DataFrame:
    """Rows of the default (or named) sheets without those of the workbooks in ``bad``."""
    rows = pick_sheet(grid, sheet)
    if bad.isEmpty():
        return rows
    return lookup_join(rows, bad.select("path").distinct(), ["path"], "left_anti")
