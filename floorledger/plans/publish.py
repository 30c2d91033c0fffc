"""Publishing: report bundles, their manifest, and chart series."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger import schema as S
from floorledger.operators.facts import as_facts, count_ops
from floorledger.functions.amounts import sum_amount
from floorledger.functions.text import month_label
from floorledger.operators.reports import hourly_by_order
from floorledger.plans.report_set import Reports


def slug(name: str) -> str:
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", "-", plain.lower()).strip("-")


def manifest(reports: Reports) -> DataFrame:
    """``ord, name, sheet, rows`` of a bundle; sheet names keep the first 31 characters."""
    counted = [
        report.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(i).alias("ord"),
            F.lit(name).alias("name"),
            F.left(F.lit(name), F.lit(S.SHEET_NAME_LIMIT)).alias("sheet"),
            "rows",
        )
        for i, (name, report) in enumerate(reports.items())
    ]
    return reduce(DataFrame.unionByName, counted).orderBy("ord")


def publish(reports: Reports, folder: str, fmt: str = "parquet") -> list[str]:
    """Write every report, in bundle order, to its own folder below ``folder``; returns the folders.

    Files keep the report's order. A report without columns has nothing to write.
    """
    written = []
    for name, report in reports.items():
        if not report.columns:
            continue
        target = f"{folder.rstrip('/')}/{slug(name)}"
        writer = report.write.mode("overwrite")
        (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(target)
        written.append(target)
    return written


def _series(rows: DataFrame, order: str) -> DataFrame:
    """Rows ``order, label, ops, monto`` as one row of three parallel arrays.

    Only used on rows that are bounded by the calendar: 23 hours, or the months of 585 years.
    """
    points = F.array_sort(F.collect_list(F.struct(order, "label", "ops", "monto")))
    one = rows.agg(points.alias("points"))
    return one.select(
        F.col("points.label").alias("labels"),
        F.col("points.ops").alias("ops"),
        F.col("points.monto").alias("monto"),
    )


def month_chart(df: DataFrame) -> DataFrame:
    totals = as_facts(df).groupBy("Mes").agg(count_ops().alias("ops"), sum_amount().alias("monto"))
    return _series(totals.withColumn("label", month_label(F.col("Mes"))), "Mes")


def hour_chart(df: DataFrame) -> DataFrame:
    """Empty arrays when there are no operations at all, else one point per hour."""
    hours = hourly_by_order(df).select(
        "ord", F.col("Hora").cast("string").alias("label"), F.col("Operaciones").alias("ops"), F.col("Monto").alias("monto")
    )
    whole = _series(hours, "ord")
    some = F.aggregate("ops", F.lit(0).cast("bigint"), lambda total, n: total + n) > 0
    kept = [F.filter(c, lambda _: some).alias(c) for c in whole.columns]
    return whole.select(*kept)


def chart_json(chart: DataFrame) -> DataFrame:
    """A chart row as the JSON text a page embeds."""
    return chart.select(F.to_json(F.struct(*chart.columns)).alias("json"))
