"""Loads: from a folder of workbooks to the history, and reports straight from one workbook."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.operators.cleaning import clean_sheets
from floorledger.operators.headers import bad_sheets, bind_headers, sheet_headers
from floorledger.operators.selection import Selection, attendants
from floorledger.operators.uploads import KEYS, latest_uploads, rows_of
from floorledger.plans.report_set import Reports, generate_reports
from floorledger.plans.rollup import has_rollups, write_rollups
from floorledger.session import checkpoint_folder, cut_lineage
from floorledger.sources.grid import pick_sheet, read_workbooks, rejected_files, stage_grid, unreadable, whole_sheets
from floorledger.sources.history import receipt, write_history
from floorledger.sources.versions import Replacement, snapshot


@dataclass(frozen=True)
class LoadResult:
    """Rows written per kind, and a frame ``path, error`` of the uploads that could not be loaded."""

    written: dict[str, int]
    errors: DataFrame
    winners: DataFrame | None = field(default=None, compare=False)

    @property
    def receipt(self) -> tuple[int, str]:
        return receipt(self.written)


def clean_grid(grid: DataFrame, sheet: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical rows of a grid's default (or named) sheets, and the uploads that cannot be loaded.

    An upload is loaded whole or not at all: rows of a workbook that could not be read to its end are
    left out. Every path of the grid that gives no canonical sheet is listed once, with a reason. The
    grid is read several times, so it should be staged; headers and problems are one small row per sheet
    and are checkpointed because the size checks, the joins and the error list all read them.
    """
    bad = cut_lineage(unreadable(grid).distinct())
    sheets = whole_sheets(grid, bad, sheet)
    headers = cut_lineage(sheet_headers(sheets))
    listed = bad.unionByName(bad_sheets(headers).select("path", "error"))
    known = bad.select("path").union(headers.select("path"))
    filled = pick_sheet(grid, sheet).select("path", F.lit("no header in the first rows").alias("error")).distinct()
    silent = grid.select("path").distinct().join(known, "path", "left_anti").join(filled, "path", "left")
    silent = silent.select("path", F.coalesce("error", F.lit("no such sheet, or an empty one")).alias("error"))
    return clean_sheets(bind_headers(sheets, headers)), listed.unionByName(silent)


def work_folder(spark: SparkSession, staging: str | None = None) -> str:
    """A new folder below ``staging``, by default below the shared checkpoint folder."""
    return f"{(staging or checkpoint_folder(spark)).rstrip('/')}/load-{uuid.uuid4().hex}"


def stage_batch(batch: DataFrame, folder: str) -> DataFrame:
    """Write canonical rows once, by kind, and read them back; cleaning then runs only once."""
    batch.hint("rebalance").write.mode("overwrite").partitionBy("Tipo").parquet(folder)
    fields = batch.schema
    return batch.sparkSession.read.schema(fields).parquet(folder).select(*fields.names)


def load_grid(
    grid: DataFrame,
    root: str,
    staging: str | None = None,
    sheet: str | None = None,
    rollups: bool = False,
    earlier: DataFrame | None = None,
) -> LoadResult:
    """Clean the grid, keep the latest upload of each kind and month, and replace those months.

    ``earlier`` holds winners (``Tipo, Mes, upload``) of earlier parts of the same run: months that a later
    upload already supplied are left alone. The staged copies live in a new folder below ``staging``, by
    default below the shared checkpoint folder, and are left there for the owner of that folder to
    expire: with ``replay`` they repeat a load that broke off.
    """
    spark = grid.sparkSession
    work = work_folder(spark, staging)
    staged = stage_grid(grid, f"{work}/grid")
    cleaned, errors = clean_grid(staged, sheet)
    batch = stage_batch(cleaned, f"{work}/batch")
    written, winners = replay(batch, root, rollups, earlier)
    return LoadResult(written, errors, winners)


def replay(
    batch: DataFrame, root: str, rollups: bool = False, earlier: DataFrame | None = None
) -> tuple[dict[str, int], DataFrame]:
    """Write a staged batch to the history and its rollups; returns rows per kind and the winners.

    Repeating it replaces the same months with the same rows. History and rollups change in one step, when
    all is written; a root that has rollups keeps them. The batch is scanned once for the winners and once
    per table that is written; the rows are counted by the writes.
    """
    batch = batch.withColumn("upload", F.struct("modified", "path"))
    winners = latest_uploads(batch, "upload")
    if earlier is not None:
        before = earlier.groupBy(*KEYS).agg(F.max("upload").alias("before"))
        fresh = winners.join(before, KEYS, "left").where("before IS NULL OR upload >= before")
        winners = cut_lineage(fresh.drop("before"))
    latest = rows_of(batch, winners, "upload")
    change = Replacement(batch.sparkSession, root)
    written = write_history(latest, root, change=change)
    if rollups or has_rollups(snapshot(batch.sparkSession, root)):
        for kind in written:
            write_rollups(latest, root, kind, change)
    if written:
        change.publish()
    return written, winners


def load_folder(spark: SparkSession, folder: str, root: str, sheet: str | None = None, **options) -> LoadResult:
    """Bulk load of every workbook below ``folder``; other files are listed among the errors."""
    result = load_grid(read_workbooks(spark, folder, sheet=sheet), root, sheet=sheet, **options)
    return LoadResult(result.written, result.errors.unionByName(rejected_files(spark, folder)), result.winners)


def process_workbook(
    spark: SparkSession, path: str, sheet: str | None = None, selection: Selection = None
) -> Reports:
    """Reports of one workbook. A sheet without a required column is an error that names the column."""
    batch, kind, has_payment_type = open_workbook(spark, path, sheet)
    return generate_reports(batch, kind, selection, has_payment_type)


def workbook_attendants(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    return attendants(open_workbook(spark, path, sheet)[0])


def open_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, str, bool]:
    """Canonical rows of one workbook, its kind, and whether it has a payment type column.

    One workbook is one task's work; only its header row, a single row, comes to the driver. The rows are
    checkpointed once cleaned, so reports do not parse them again.
    """
    grid = cut_lineage(read_workbooks(spark, path, recursive=False, sheet=sheet))
    problem = unreadable(grid).first()
    if problem:
        raise ValueError(f"{problem['path']}: {problem['error']}")
    sheets = pick_sheet(grid, sheet)
    headers = sheet_headers(sheets)
    header = headers.first()
    if header is None:
        raise ValueError(f"{path}: no header in the first rows, or an empty sheet")
    if header["missing"]:
        raise ValueError(f"{path}: missing column: {', '.join(header['missing'])}")
    batch = cut_lineage(clean_sheets(bind_headers(sheets, headers)))
    has_payment_type = header["at"]["FormaPago"] is not None
    return batch, header["Tipo"], has_payment_type

