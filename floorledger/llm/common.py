"""Helpers shared by the operators: staged tables, distributed numbering, Arrow batch sizes."""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorledger.session import checkpoint_folder

ROWS_PER_BUCKET = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(docs: DataFrame) -> Column:
    """All columns as one struct, ``row``: whatever they are called, they clash with nothing that is added beside it."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound what one Arrow batch carries: texts may be long, so rows alone are no bound."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage, so a lost executor costs a reread, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged frame that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unit_hash(*columns) -> Column:
    """A hash as an integer in [0, 2^31)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 33)


def numbered(
    df: DataFrame, group: list[str], order: str, rows: int, weight: str | None = None, ties: list[str] = ()
) -> DataFrame:
    """Number the rows of each group from 0 in the order of ``order``, an integer in [0, 2^31) spread evenly.

    Adds ``n`` and, with ``weight``, ``before``: the sum of the weights of earlier rows of the group.
    A group of any size is cut into buckets of the order; buckets are numbered by their totals, rows
    inside their bucket, so no task holds a whole group. ``df`` is read twice and must be staged or
    otherwise stable; group columns hold no nulls. ``rows`` is the row count or an upper bound of it.
    """
    buckets = max(1, ceil(rows / ROWS_PER_BUCKET))
    keys = [*group, "__bucket"]
    df = df.withColumn("__bucket", F.floor(F.col(order) * F.lit(buckets) / F.lit(1 << 31)).cast("int"))
    totals = [F.count(F.lit(1)).alias("__rows")]
    if weight:
        totals.append(F.sum(weight).alias("__weight"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = df.groupBy(*keys).agg(*totals)
    starts = starts.select(
        *keys,
        F.coalesce(F.sum("__rows").over(earlier), zero).alias("__n"),
        *([F.coalesce(F.sum("__weight").over(earlier), zero).alias("__before")] if weight else []),
    )
    inside = Window.partitionBy(*keys).orderBy(order, *ties)
    df = df.withColumn("n", F.row_number().over(inside) - F.lit(1))
    if weight:
        running = inside.rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("before", F.coalesce(F.sum(weight).over(running), zero))
    df = df.join(starts, keys).withColumn("n", F.col("n") + F.col("__n"))
    if weight:
        df = df.withColumn("before", F.col("before") + F.col("__before"))
    return df.drop("__bucket", "__n", "__before")
