"""History tables: storage form, scans, and the sink that replaces months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger import schema as S
from floorledger.operators.cleaning import NULL_TEXT
from floorledger.sources.versions import Replacement, publish, read_table, snapshot

TABLES = {S.GETNET: S.OPERATIONS_TABLE, S.PREMIOS: S.PRIZES_TABLE}
TABLE_SCHEMAS = {S.GETNET: S.OPERATIONS_TABLE_SCHEMA, S.PREMIOS: S.PRIZES_TABLE_SCHEMA}


def _text(df: DataFrame, column: str, null_text: str) -> Column:
    """Stored text: empty for a column the batch does not have, ``null_text`` for an empty cell."""
    if column not in df.columns:
        return F.lit("")
    return F.coalesce(F.col(column).cast("string"), F.lit(null_text))


def _moments() -> list[Column]:
    return [F.col("Fecha").alias("fecha"), F.col("Jornada").cast("timestamp_ntz").alias("jornada")]


def _shared(df: DataFrame, null_text: str) -> list[Column]:
    return [
        F.col("Attendant").alias("attendant"),
        _text(df, "Validador", null_text).alias("validador"),
        _text(df, "FormaPago", null_text).alias("forma_pago"),
        _text(df, "Ingreso", null_text).alias("ingreso_cawa"),
        F.col("Hora").alias("hora"),
        F.col("Mes").alias("mes"),
    ]


def store_operations(df: DataFrame, null_text: str = NULL_TEXT) -> DataFrame:
    """Canonical card operations in storage form."""
    return df.select(
        *_moments(),
        _text(df, "IdCliente", null_text).alias("id_cliente"),
        F.col("Monto").alias("monto"),
        _text(df, "Voucher", null_text).alias("voucher"),
        *_shared(df, null_text),
    )


def store_prizes(df: DataFrame, null_text: str = NULL_TEXT) -> DataFrame:
    """Canonical prizes in storage form."""
    tip = F.col("Propina") if "Propina" in df.columns else F.lit(0.0)
    return df.select(
        *_moments(),
        _text(df, "IdCliente", null_text).alias("id_cliente"),
        F.col("Monto").alias("monto"),
        tip.cast("double").alias("propina"),
        _text(df, "Maquina", null_text).alias("maquina"),
        *_shared(df, null_text),
    )


def store(df: DataFrame, kind: str, null_text: str = NULL_TEXT) -> DataFrame:
    return (store_prizes if kind == S.PREMIOS else store_operations)(df, null_text)


def scan(stored: DataFrame, kind: str) -> DataFrame:
    """Stored rows under their report names; month and hour come from storage."""
    columns = [F.col(c).alias(S.REPORT_NAMES.get(c, c)) for c in stored.columns]
    return stored.select(
        *columns, F.to_date("jornada").alias("JornadaDia"), F.lit(kind).alias("Tipo")
    )


def create_tables(spark: SparkSession, root: str) -> None:
    """Publish a first state without months, unless there is one. Existing rows are never touched."""
    if snapshot(spark, root) is None:
        publish(spark, root, lambda tables: tables or {table: {} for table in TABLES.values()})


def read_history(spark: SparkSession, root: str, kind: str, number: int | None = None) -> DataFrame:
    """The history of one kind, now or in state ``number``; months, columns and filters are pruned at the scan."""
    return scan(read_table(spark, root, TABLES[kind], TABLE_SCHEMAS[kind], number=number), kind)


def write_history(
    batch: DataFrame, root: str, null_text: str = NULL_TEXT, change: Replacement | None = None
) -> dict[str, int]:
    """Route a canonical batch by kind and replace its months; returns rows written per kind.

    Every month that occurs in the batch is replaced in its kind's table, other months stay, and both
    kinds change at once. The rows are counted by the writes. ``batch`` is read once per kind, so it
    should be a staged table partitioned by ``Tipo``. With ``change`` its owner publishes.
    """
    own = change or Replacement(batch.sparkSession, root)
    counts = {k: own.write(store(batch.where(F.col("Tipo") == k), k, null_text), table) for k, table in TABLES.items()}
    written = {kind: rows for kind, rows in counts.items() if rows}
    if change is None and written:
        own.publish()
    return written


def receipt(written: dict[str, int]) -> tuple[int, str]:
    """Rows written and their kind, or ``(0, "No data")``."""
    total = sum(written.values())
    if not total:
        return 0, "No data"
    return total, "+".join(kind for kind, rows in written.items() if rows)

