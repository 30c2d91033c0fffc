"""Attendant lists, filters and searches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.operators.lookups import lookup_join, measure
from floorledger.session import cut_lineage

Selection = Iterable[str] | DataFrame | None


def attendants(df: DataFrame) -> DataFrame:
    """Distinct attendants, ascending."""
    return df.select("Attendant").where(F.col("Attendant").isNotNull()).distinct().orderBy("Attendant")


def search_attendants(df: DataFrame, text: str) -> DataFrame:
    """Attendants whose name contains ``text`` in any case."""
    return attendants(df.where(F.contains(F.lower("Attendant"), F.lit(text.lower()))))


def filter_attendants(df: DataFrame, selection: Selection = None) -> DataFrame:
    """Rows of the selected attendants; an empty selection keeps every row.

    A list becomes a membership test, a table with an ``Attendant`` column a semi join. The table's names
    are worked out once and counted and measured in one pass.
    """
    if selection is None:
        return df
    if isinstance(selection, DataFrame):
        names = cut_lineage(selection.select("Attendant").where(F.col("Attendant").isNotNull()).distinct())
        rows, size = measure(names)
        return lookup_join(df, names, ["Attendant"], "left_semi", size=size) if rows else df
    names = list(dict.fromkeys(selection))
    return df.where(F.col("Attendant").isin(names)) if names else df


def covers_everyone(df: DataFrame, selection: Selection) -> bool:
    """Whether a filter would change nothing: nothing selected, or exactly the attendants there are.

    Compared on the executors; only the two answers "any selected but absent" and "any present but not
    selected" reach the driver.
    """
    if selection is None:
        return True
    if not isinstance(selection, DataFrame):
        names = list(dict.fromkeys(selection))
        if not names:
            return True
        selection = df.sparkSession.createDataFrame([(n,) for n in names], "Attendant string")
    chosen = selection.select("Attendant").distinct()
    if chosen.isEmpty():
        return True
    present = df.select("Attendant").where(F.col("Attendant").isNotNull()).distinct()
    only_here = present.select("Attendant", F.lit(1).alias("present"), F.lit(0).alias("chosen"))
    only_there = chosen.select("Attendant", F.lit(0).alias("present"), F.lit(1).alias("chosen"))
    both = only_here.unionByName(only_there).groupBy("Attendant").agg(
        F.max("present").alias("present"), F.max("chosen").alias("chosen")
    )
    return both.where(F.col("present") != F.col("chosen")).isEmpty()
