"""Several uploads in one load: the latest one decides each month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.operators.lookups import lookup_join
from floorledger.session import cut_lineage

KEYS = ["Tipo", "Mes"]


def _order(upload: str) -> Column:
    """The upload as a struct: never null itself, and a null inside is the oldest and equal to other nulls."""
    return F.struct(F.col(upload)).alias("upload")


def latest_uploads(batch: DataFrame, upload: str = "upload_seq") -> DataFrame:
    """``Tipo, Mes, upload``: the last upload that contains each kind and month.

    One pass over narrow columns, worked out once: it serves the filter and later batches.
    """
    last = batch.groupBy(*KEYS).agg(F.max(_order(upload)).alias("upload"))
    return cut_lineage(last)


def rows_of(batch: DataFrame, winners: DataFrame, upload: str = "upload_seq") -> DataFrame:
    """Rows of ``batch`` that belong to the ``winners``, which are measured before they are broadcast."""
    key = F.struct(*KEYS, _order(upload)).alias("__won")
    won = winners.select(F.struct(*KEYS, "upload").alias("__won"))
    return lookup_join(batch.withColumn("__won", key), won, ["__won"], "left_semi").drop("__won")


def latest_upload_wins(batch: DataFrame, upload: str = "upload_seq") -> DataFrame:
    """Rows of the last upload that contains their kind and month.

    Equal to loading the uploads one after the other, each replacing its months. A null upload number is
    the oldest. The winners are one row per kind and month; the batch is not shuffled when they are few,
    however many rows one month holds.
    """
    return rows_of(batch, latest_uploads(batch, upload), upload)


def load_receipt(batch: DataFrame) -> DataFrame:
    """Rows to be written per kind; a kind without rows has no receipt."""
    return batch.groupBy("Tipo").agg(F.count(F.lit(1)).alias("rows"))
