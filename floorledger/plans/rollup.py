"""Rollups of the history: two small additive tables that every report can be computed from.

A report set over the history scans it once per report. Over the rollups it reads tables with one row per
attendant, hour and class of a day, and per machine, attendant and class of a month. All measures add
up, so the results are the same. A month replacement recomputes only its months.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorledger import schema as S
from floorledger.operators.facts import CLASS, as_facts, fold
from floorledger.operators.selection import Selection
from floorledger.plans.report_set import FactSet, Reports, generate_reports
from floorledger.session import staged
from floorledger.sources.history import scan, store
from floorledger.sources.versions import Replacement, Snapshot, read_table

PEOPLE_KEYS = ["Tipo", "Mes", "JornadaDia", "Hora", "Attendant", CLASS]
MACHINE_KEYS = ["Tipo", "Mes", "Maquina", "Attendant", CLASS]
#: What the facts of canonical rows are made of.
FACT_COLUMNS = ["Tipo", "Fecha", "JornadaDia", "Mes", "Hora", "Monto", "Attendant", "FormaPago", "Maquina"]
PEOPLE_TABLE, MACHINE_TABLE = "rollup_people", "rollup_machines"
PEOPLE_FIELDS = "Tipo string, JornadaDia date, Hora int, Attendant string, Categoria string"
MACHINE_FIELDS = "Tipo string, Maquina string, Attendant string, Categoria string"
FACT_FIELDS = (
    "ops bigint, amt_units bigint, amt_cents bigint, amt_rest double, "
    "first_moment timestamp_ntz, last_moment timestamp_ntz, Mes string"
)


def roll_up(df: DataFrame) -> FactSet:
    """Rollups of canonical rows or of a history scan."""
    facts = as_facts(df)
    for column in ("Maquina", CLASS):
        if column not in facts.columns:
            facts = facts.withColumn(column, F.lit(None).cast("string"))
    return FactSet(fold(facts, *PEOPLE_KEYS), fold(facts, *MACHINE_KEYS))


class StagedFacts(FactSet):
    """Rollups worked out once each, when first asked for."""

    def __init__(self, rollups: FactSet, kind: str):
        self.__dict__.update(rollups=rollups, kind=kind)

    @cached_property
    def people(self) -> DataFrame:
        return staged(self.rollups.people)

    @cached_property
    def machines(self) -> DataFrame:
        return staged(self.rollups.machines) if self.kind == S.PREMIOS else self.rollups.machines


def stage_facts(df: DataFrame, kind: str) -> FactSet:
    """Rollups worked out once, for a whole report set: at most two scans of ``df`` instead of one per report."""
    return StagedFacts(roll_up(df), kind)


def report_bundle(
    df: DataFrame, kind: str, attendants: Selection = None, has_payment_type: bool | None = None
) -> Reports:
    """All reports of one kind from staged facts: what bundles, manifests and publishing should be made from."""
    if has_payment_type is None:
        has_payment_type = "FormaPago" in df.columns or CLASS in df.columns
    return generate_reports(stage_facts(df, kind), kind, attendants, has_payment_type)


def _table(table: str, kind: str) -> str:
    return f"{table}_{kind.lower()}"


def has_rollups(state: Snapshot | None) -> bool:
    return state is not None and any(t.startswith((PEOPLE_TABLE, MACHINE_TABLE)) for t in state.tables)


def write_rollups(batch: DataFrame, root: str, kind: str, change: Replacement | None = None) -> None:
    """Replace the rollup months that occur in ``batch``, which must hold those months whole.

    The rows are taken in the form the history stores and returns them, so rollups and history give the
    same reports. With ``change``, its owner publishes: rollups and history then change at once.
    """
    own = change or Replacement(batch.sparkSession, root)
    rollups = roll_up(scan(store(batch.where(F.col("Tipo") == kind), kind), kind))
    own.write(rollups.people, _table(PEOPLE_TABLE, kind), "Mes")
    own.write(rollups.machines, _table(MACHINE_TABLE, kind), "Mes")
    if change is None:
        own.publish()


def read_rollups(spark: SparkSession, root: str, kind: str, number: int | None = None) -> FactSet:
    return FactSet(
        read_table(spark, root, _table(PEOPLE_TABLE, kind), _fields(PEOPLE_FIELDS), "Mes", number),
        read_table(spark, root, _table(MACHINE_TABLE, kind), _fields(MACHINE_FIELDS), "Mes", number),
    )


def _fields(keys: str) -> T.StructType:
    return T.StructType.fromDDL(f"{keys}, {FACT_FIELDS}")
