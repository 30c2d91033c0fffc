"""Facts: the additive form every report aggregates.

A fact row stands for ``ops`` operations with their amount parts and first and last moment. A canonical
row is one fact with ``ops = 1``; a rollup row stands for many. Reports add facts up, so the same report
code runs over the history and over its rollups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions.amounts import amount_parts, sum_parts
from floorledger.functions.text import payment_class

OPS = "ops"
FIRST, LAST = "first_moment", "last_moment"
CLASS = "Categoria"


def is_facts(df: DataFrame) -> bool:
    return OPS in df.columns


def as_facts(df: DataFrame) -> DataFrame:
    """Canonical rows as facts; facts are returned as they are. Unused columns are pruned by Catalyst."""
    if is_facts(df):
        return df
    extra = [payment_class(F.col("FormaPago")).alias(CLASS)] if "FormaPago" in df.columns else []
    return df.select(
        "*",
        F.lit(1).cast("bigint").alias(OPS),
        *amount_parts(F.col("Monto")),
        F.col("Fecha").alias(FIRST),
        F.col("Fecha").alias(LAST),
        *extra,
    )


def count_ops(condition: Column | None = None) -> Column:
    """Number of operations; 0 when there are none."""
    value = F.col(OPS) if condition is None else F.when(condition, F.col(OPS))
    return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))


def fold(df: DataFrame, *keys: str) -> DataFrame:
    """Facts added up to one row per ``keys``."""
    return (
        as_facts(df)
        .groupBy(*keys)
        .agg(F.sum(OPS).alias(OPS), *sum_parts(), F.min(FIRST).alias(FIRST), F.max(LAST).alias(LAST))
    )
