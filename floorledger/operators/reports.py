"""The report catalogue: one function per report, from canonical rows or facts to a lazy DataFrame.

Every report is one partial-then-final aggregation (two for the record) and one sort of the aggregated
rows. A key that holds a third of all rows folds to one row per task before any shuffle. Months are
sorted by their key and labelled afterwards. Orders are total, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger import schema as S
from floorledger.functions.amounts import sum_amount
from floorledger.functions.text import month_label, timestamp_text
from floorledger.operators.cleaning import settle
from floorledger.operators.facts import CLASS, FIRST, LAST, as_facts, count_ops, fold, is_facts

CLASSES = list(S.PAYMENT_CLASSES)


def _count() -> Column:
    return count_ops().alias("Operaciones")


def _shown_month() -> Column:
    return month_label(F.col("Mes")).alias("Mes")


def _class_counts() -> list[Column]:
    """All four class columns, whether or not the class occurs."""
    return [count_ops(F.col(CLASS) == c).alias(c) for c in CLASSES]


def classified(df: DataFrame) -> DataFrame:
    """Facts with a payment class; the class of raw rows is worked out once, for filter and counts."""
    facts = as_facts(df) if is_facts(df) else as_facts(df).transform(settle, CLASS)
    return facts.where(F.col(CLASS).isNotNull())


def monthly_summary(df: DataFrame) -> DataFrame:
    totals = as_facts(df).groupBy("Mes").agg(_count(), sum_amount().alias("Monto"))
    return totals.orderBy("Mes").select(_shown_month(), "Operaciones", "Monto")


def hour_dimension(df: DataFrame) -> DataFrame:
    """The 23 hours in operating-day order: ``ord, Hora``."""
    hours = F.array(*[F.lit(h) for h in S.HOUR_ORDER])
    return df.sparkSession.range(1, numPartitions=1).select(F.posexplode(hours).alias("ord", "Hora"))


def hourly_by_order(df: DataFrame) -> DataFrame:
    """``ord, Hora, Operaciones, Monto`` for each of the 23 hours, absent ones as 0.

    The aggregate holds at most 23 rows once other hours are out, so it is safe to broadcast.
    """
    totals = (
        as_facts(df)
        .where(F.col("Hora").isin(S.HOUR_ORDER))
        .groupBy("Hora")
        .agg(_count(), sum_amount().alias("Monto"))
    )
    return hour_dimension(df).join(F.broadcast(totals), "Hora", "left").select(
        "ord",
        "Hora",
        F.coalesce("Operaciones", F.lit(0).cast("bigint")).alias("Operaciones"),
        F.coalesce("Monto", F.lit(0.0)).alias("Monto"),
    )


def hourly_operations(df: DataFrame) -> DataFrame:
    ordered = hourly_by_order(df).orderBy("ord")
    return ordered.select(F.col("Hora").cast("string").alias("Hora"), "Operaciones", "Monto")


def attendant_days(df: DataFrame) -> DataFrame:
    return as_facts(df).groupBy("Attendant", "JornadaDia").agg(count_ops().alias("TotalOperaciones"))


def attendant_record(df: DataFrame) -> DataFrame:
    """Busiest operating day of each attendant, the earliest one when several tie.

    Folding with the largest (total, earlier day) pair needs no window sort per attendant.
    """
    earlier = -F.unix_date("JornadaDia")
    best = F.max(F.struct("TotalOperaciones", earlier.alias("earlier"), "JornadaDia")).alias("best")
    return (
        attendant_days(df)
        .groupBy("Attendant")
        .agg(best)
        .select("Attendant", "best.JornadaDia", "best.TotalOperaciones")
        .orderBy(F.desc("TotalOperaciones"), "Attendant")
    )


def attendant_month(df: DataFrame, with_amount: bool = True) -> DataFrame:
    """Operations of each attendant and month; the amount is shown for card operations only."""
    measures = [_count()] + ([sum_amount().alias("Monto")] if with_amount else [])
    totals = as_facts(df).groupBy("Attendant", "Mes").agg(*measures)
    ordered = totals.orderBy("Mes", F.desc("Operaciones"), "Attendant")
    return ordered.select("Attendant", _shown_month(), "Operaciones", *(["Monto"] if with_amount else []))


def operation_count(df: DataFrame) -> DataFrame:
    totals = as_facts(df).groupBy("Mes", "Attendant").agg(_count())
    ordered = totals.orderBy("Mes", F.desc("Operaciones"), "Attendant")
    return ordered.select(_shown_month(), "Attendant", "Operaciones")


def operation_count_by_class(df: DataFrame) -> DataFrame:
    totals = classified(df).groupBy("Mes", "Attendant").agg(*_class_counts())
    return totals.orderBy("Mes", F.desc("Premios"), "Attendant").select(_shown_month(), "Attendant", *CLASSES)


def annual_count(df: DataFrame) -> DataFrame:
    """Operations of each attendant over all data; there is no year key."""
    totals = as_facts(df).groupBy("Attendant").agg(_count())
    return totals.orderBy(F.desc("Operaciones"), "Attendant")


def annual_count_by_class(df: DataFrame) -> DataFrame:
    totals = classified(df).groupBy("Attendant").agg(*_class_counts())
    return totals.orderBy(F.desc("Premios"), "Attendant")


def annual_count_classified(df: DataFrame) -> DataFrame:
    return annual_count(classified(df))


def _machine_measures() -> list[Column]:
    """Class counts with the prize amount after the first; other classes add nothing to it."""
    first, *others = _class_counts()
    return [first, sum_amount(F.col(CLASS) == "Premios").alias("Monto"), *others]


def _machines(df: DataFrame) -> DataFrame:
    return classified(df).where(F.col("Maquina").isNotNull())


MACHINE_COLUMNS = ["Maquina", "Premios", "Monto", *CLASSES[1:]]


def machine_month(df: DataFrame) -> DataFrame:
    """Counts and prize amount of each month and machine, in one aggregation.

    Counting classified rows and adding the prize amount of all rows need no join: an unclassified row
    adds 0, and a group without a classified row is not reported.
    """
    totals = _machines(df).groupBy("Mes", "Maquina").agg(*_machine_measures())
    return totals.orderBy("Mes", F.desc("Premios"), "Maquina").select(_shown_month(), *MACHINE_COLUMNS)


def machine_total(df: DataFrame) -> DataFrame:
    totals = _machines(df).groupBy("Maquina").agg(*_machine_measures())
    return totals.orderBy(F.desc("Premios"), "Maquina").select(*MACHINE_COLUMNS)


def machine_grouping_sets(df: DataFrame) -> DataFrame:
    """Both machine reports in one pass over the data; ``Mes`` is null in the rows over all months.

    The rows fold by month, machine and class first; the grouping sets double those few rows only.
    """
    sets = [[F.col("Mes"), F.col("Maquina")], [F.col("Maquina")]]
    folded = fold(_machines(df), "Mes", "Maquina", CLASS)
    totals = folded.groupingSets(sets, "Mes", "Maquina").agg(*_machine_measures())
    return totals.orderBy(F.asc_nulls_last("Mes"), F.desc("Premios"), "Maquina").select("Mes", *MACHINE_COLUMNS)


def machine_month_joined(df: DataFrame) -> DataFrame:
    """The literal form of ``machine_month``: counts left-joined with prize amounts over all rows."""
    keys = ["Mes", "Maquina"]
    facts = as_facts(df).where(F.col("Maquina").isNotNull())
    counts = facts.where(F.col(CLASS).isNotNull()).groupBy(*keys).agg(*_class_counts())
    prize = F.coalesce(F.col(CLASS) == "Premios", F.lit(False))
    amounts = facts.groupBy(*keys).agg(sum_amount(prize).alias("Monto"))
    joined = counts.join(amounts, keys, "left")
    return joined.orderBy("Mes", F.desc("Premios"), "Maquina").select(_shown_month(), *MACHINE_COLUMNS)


def prize_amounts(df: DataFrame, *keys: str) -> DataFrame:
    """Prize amount per key over all rows, classified or not."""
    facts = as_facts(df)
    for key in keys:
        facts = facts.where(F.col(key).isNotNull())
    prize = F.coalesce(F.col(CLASS) == "Premios", F.lit(False))
    return facts.groupBy(*keys).agg(sum_amount(prize).alias("MontoPremios"))


def quality(df: DataFrame) -> DataFrame:
    """Four metrics as text: rows used, first and last moment, hours present."""
    seen = F.concat_ws(", ", F.transform(F.array_sort(F.collect_set("Hora")), lambda h: h.cast("string")))
    row = as_facts(df).agg(
        count_ops().cast("string").alias("filas_usadas"),
        timestamp_text(F.min(FIRST)).alias("min_fecha"),
        timestamp_text(F.max(LAST)).alias("max_fecha"),
        seen.alias("horas_presentes"),
    )
    metrics = [F.struct(F.lit(c).alias("Metrica"), F.col(c).alias("Valor")) for c in row.columns]
    return row.select(F.inline(F.array(*metrics)))


def months(df: DataFrame) -> DataFrame:
    """Distinct months of a batch."""
    return df.select("Mes").distinct()

