"""Finding the header row of each sheet, its kind, and where the known columns are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger import schema as S
from floorledger.functions.text import strip
from floorledger.operators.lookups import lookup_join

SHEET = ["path", "sheet"]


def _holds(names: Column, keys: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), names)) == 0


def detect_headers(grid: DataFrame) -> DataFrame:
    """One row per sheet: ``path, sheet, header_row, names``.

    The header is the first of the leading 30 rows whose cells hold all names of either key set, else
    row 0. Only those rows are scanned, and each sheet folds to one row before the shuffle.
    """
    names = F.transform("cells", lambda cell: strip(cell))
    head = grid.where(F.col("row_idx") < S.HEADER_SEARCH_ROWS).select(
        *SHEET, "row_idx", names.alias("names")
    )
    here = F.struct("row_idx", "names")
    is_header = _holds(F.col("names"), S.HEADER_KEYS_GETNET) | _holds(F.col("names"), S.HEADER_KEYS_PREMIOS)
    return (
        head.groupBy(*SHEET)
        .agg(
            F.min(F.when(is_header, here)).alias("found"),
            F.min(F.when(F.col("row_idx") == 0, here)).alias("first"),
        )
        .select(
            *SHEET,
            F.coalesce("found.row_idx", F.lit(0)).alias("header_row"),
            F.coalesce("found.names", "first.names", F.array().cast("array<string>")).alias("names"),
        )
    )


def detect_kind(headers: DataFrame) -> DataFrame:
    """Add ``Tipo``: prizes when both marker columns are there, card operations otherwise."""
    prizes = _holds(F.col("names"), S.KIND_KEYS_PREMIOS)
    return headers.withColumn("Tipo", F.when(prizes, S.PREMIOS).otherwise(S.GETNET))


def _position(spellings: list[str]) -> Column:
    """0-based place of the first spelling that occurs in ``names``, null when none does."""
    places = [F.array_position("names", s) for s in spellings]
    return F.coalesce(*[F.when(p > 0, (p - 1).cast("int")) for p in places])


def locate_columns(headers: DataFrame) -> DataFrame:
    """Add ``at``, the place of every canonical column, and ``missing``, the required ones not found.

    The place is worked out once per sheet, so binding a data row is an array lookup per column. Prize
    sheets without a date header take their first column as the date, and without an operating-day
    header derive it, so neither counts as missing there.
    """
    prizes = F.col("Tipo") == S.PREMIOS
    places = {}
    for column, spellings in S.HEADERS_COMMON.items():
        place = _position(spellings)
        if column in S.HEADERS_PREMIOS:
            place = F.when(prizes, _position(S.HEADERS_PREMIOS[column])).otherwise(place)
        places[column] = place
    places["Fecha"] = F.coalesce(places["Fecha"], F.when(prizes, F.lit(0)))
    required = [
        F.when(
            places[c].isNull() & (~prizes if c == "Jornada" else F.lit(True)),
            F.lit(c),
        )
        for c in S.REQUIRED_COLUMNS
    ]
    return headers.select(
        "*",
        F.struct(*[place.alias(c) for c, place in places.items()]).alias("at"),
        F.array_compact(F.array(*required)).alias("missing"),
    )


def sheet_headers(grid: DataFrame) -> DataFrame:
    return grid.transform(detect_headers).transform(detect_kind).transform(locate_columns)


def bad_sheets(headers: DataFrame) -> DataFrame:
    """Sheets that cannot be loaded, with the columns they lack."""
    text = F.concat(F.lit("missing column: "), F.concat_ws(", ", "missing"))
    return headers.where(F.size("missing") > 0).select(*SHEET, text.alias("error"))


def present(cell: Column) -> Column:
    """The cell's text; null for the spellings of a missing value."""
    return F.when(~cell.isin(S.MISSING_TEXT), cell)


def bind_headers(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below each header as named text columns.

    A column the sheet does not have is the empty text, an empty cell or a missing-value spelling is null,
    so later steps can tell one from the other. Sheets with a missing required column are left out (see ``bad_sheets``).
    """
    usable = headers.where(F.size("missing") == 0).select(*SHEET, "header_row", "Tipo", "at")
    rows = lookup_join(grid.select(*SHEET, "modified", "row_idx", "cells"), usable, SHEET)
    below = rows.where(F.col("row_idx") > F.col("header_row"))
    cells = [
        F.when(F.col(f"at.{c}").isNull(), F.lit("")).otherwise(present(F.get("cells", F.col(f"at.{c}")))).alias(c)
        for c in S.HEADERS_COMMON
    ]
    return below.select(
        *SHEET, "modified", "row_idx", "Tipo", *cells, F.col("at.Jornada").isNotNull().alias("has_jornada")
    )


def named_headers(headers: DataFrame) -> DataFrame:
    """``path, sheet, header_row, names`` with one name per column.

    Empty names become ``Unnamed: <place>``. Repeated names get the first free number (``Monto``,
    ``Monto.1``), so every name is unique whatever the sheet calls its other columns.
    """
    name = F.transform(
        "names", lambda n, i: F.when(F.coalesce(n, F.lit("")) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(n)
    )
    plain = headers.select(*SHEET, "header_row", name.alias("names"))

    def free(taken: Column, n: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(1), F.size("names")), lambda k: F.concat(n, F.lit("."), k.cast("string")))
        return F.get(F.array_except(F.array_except(numbered, taken), F.col("names")), F.lit(0))

    unique = F.aggregate(
        "names",
        F.array().cast("array<string>"),
        lambda taken, n: F.array_append(taken, F.when(F.array_contains(taken, n), free(taken, n)).otherwise(n)),
    )
    return plain.select(*SHEET, "header_row", F.when(F.size("names") > 0, unique).otherwise(F.col("names")).alias("names"))


def named_cells(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below each header as ``path, sheet, row_idx, fields`` with every named column, known or not."""
    rows = lookup_join(grid.select(*SHEET, "row_idx", "cells"), named_headers(headers), SHEET)
    below = rows.where((F.col("row_idx") > F.col("header_row")) & (F.size("names") > 0))
    values = F.transform("names", lambda n, i: present(F.get("cells", i)))
    return below.select(*SHEET, "row_idx", F.map_from_arrays("names", values).alias("fields"))


def name_statistics(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """``path, name, cells, filled, longest`` of every named column: its rows, those with a value, the longest text.

    Cells are counted by their place, where they fold to one row per column before the shuffle; only those
    few rows are joined with names.
    """
    keyed = named_headers(headers)
    widths = keyed.select(*SHEET, "header_row", F.size("names").alias("width")).where("width > 0")
    rows = lookup_join(grid.select(*SHEET, "row_idx", "cells"), widths, SHEET).where("row_idx > header_row")
    missing = F.array_repeat(F.lit(None).cast("string"), F.greatest(F.col("width") - F.size("cells"), F.lit(0)))
    placed = rows.select(*SHEET, F.posexplode(F.slice(F.concat("cells", missing), 1, F.col("width"))).alias("place", "cell"))
    placed = placed.select(*SHEET, "place", present(F.col("cell")).alias("value"))
    found = placed.groupBy(*SHEET, "place").agg(
        F.count(F.lit(1)).alias("cells"), F.count("value").alias("filled"), F.max(F.length("value")).alias("longest")
    )
    names = keyed.select(*SHEET, F.posexplode("names").alias("place", "name"))
    return found.join(names, [*SHEET, "place"]).groupBy("path", "name").agg(
        F.sum("cells").alias("cells"), F.sum("filled").alias("filled"), F.max("longest").alias("longest")
    )
