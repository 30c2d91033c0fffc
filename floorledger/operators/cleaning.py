"""From bound text rows to the canonical batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger import schema as S
from floorledger.functions.amounts import parse_amount
from floorledger.functions.dates import month_key, operating_day, parse_day_first

NULL_TEXT = "nan"


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """Compute ``columns`` once per row, whatever is filtered on later.

    Catalyst moves a filter below the projection that makes its column and repeats the expression there.
    For a costly parse used by several filters that means parsing each cell several times. A one-row
    inline table stays in generated code and is not crossed by filters on its columns.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*columns))))


def read_values(bound: DataFrame) -> DataFrame:
    """Text cells -> typed columns: two dates, two amounts, one machine column."""
    parsed = {name: parse_day_first(F.col(name)) for name in ("Fecha", "Jornada")}
    return bound.withColumns(parsed).transform(settle, *parsed).withColumns(
        {
            "Monto": parse_amount(F.col("Monto")),
            # 0 only when the sheet has no such column.
            "Propina": F.when(F.col("Propina") == "", 0.0).otherwise(parse_amount(F.col("Propina"), None)),
            # Either spelling of the machine header counts.
            "Maquina": F.when(F.col("MaquinaAccented") == "", F.col("Maquina")).otherwise(F.col("MaquinaAccented")),
        }
    ).drop("MaquinaAccented")


def derive_operating_day(df: DataFrame) -> DataFrame:
    """Fill ``Jornada`` of prize sheets that lack the column with the operating day of ``Fecha``."""
    derived = operating_day(F.col("Fecha")).cast("timestamp_ntz")
    lacks = ~F.col("has_jornada") & (F.col("Tipo") == S.PREMIOS)
    return df.withColumn("Jornada", F.when(lacks, derived).otherwise(F.col("Jornada"))).drop("has_jornada")


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["Fecha", "Jornada", "Attendant"])


def add_calendar(df: DataFrame) -> DataFrame:
    """Operating-day date, clock hour and month; the month follows the operating day, not the clock."""
    day = F.to_date("Jornada")
    return df.withColumns({"JornadaDia": day, "Hora": F.hour("Fecha"), "Mes": month_key(day)})


def keep_valid_hours(df: DataFrame) -> DataFrame:
    """Hour 9 lies between two operating days and is dropped."""
    return df.where(F.hour("Fecha").isin(S.HOUR_ORDER))


def complete_batch(df: DataFrame) -> DataFrame:
    """The shared end of cleaning, for rows that already have typed columns."""
    return df.transform(drop_incomplete).transform(keep_valid_hours).transform(add_calendar)


def clean_sheets(bound: DataFrame) -> DataFrame:
    """Canonical batch of bound sheet rows, plus ``path, sheet, modified`` of the upload."""
    batch = (
        bound.transform(read_values).transform(derive_operating_day).transform(complete_batch)
    )
    return batch.select("path", "sheet", "modified", *S.CANONICAL_SCHEMA.names)
