"""Versioned month folders: a change of many tables becomes visible at once, or not at all.

Every change writes the months it replaces to folders of its own. A published file then names, for each month
of each table, the version that holds it now. Readers look there first, so they see all of a change or
nothing of it, whatever step it broke off at, and go on reading the old folders while it runs.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorledger.sources.files import Folder

PUBLISHED = "_published"
ATTEMPTS = 100


@dataclass(frozen=True)
class Snapshot:
    """State ``number`` of the tables below a root: ``tables[table][month]`` is the version that holds the month."""

    number: int = 0
    tables: dict[str, dict[str, str]] = field(default_factory=dict)


def _name(number: int) -> str:
    return f"{number:012d}.json"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The published states that can be read, oldest first."""
    names = Folder(spark, root).names(PUBLISHED)
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> Snapshot | None:
    """The state ``number``, by default the last one; None if nothing was ever published."""
    if number is None:
        number = max(numbers(spark, root), default=None)
    if number is None:
        return None
    return Snapshot(number, json.loads(Folder(spark, f"{root.rstrip('/')}/{PUBLISHED}").read(_name(number))))


def publish(spark: SparkSession, root: str, change) -> Snapshot:
    """Publish ``change(tables)`` of the last state as the next one.

    A state's file is made whole under its number or not at all, and only once. Of several writers one gets
    the number; the others apply their change to its state and try the next, so no change is lost.
    """
    folder = Folder(spark, f"{root.rstrip('/')}/{PUBLISHED}")
    for _ in range(ATTEMPTS):
        now = snapshot(spark, root) or Snapshot()
        after = Snapshot(now.number + 1, change(now.tables))
        if folder.make(_name(after.number), json.dumps(after.tables, sort_keys=True)):
            return after
    raise RuntimeError(f"{root}: other writers took {ATTEMPTS} numbers in a row")


class Replacement:
    """Months of several tables to be replaced together: ``write`` each table, then ``publish`` once.

    What is written before a failure is never read; ``expire`` deletes it later.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.version = f"v{uuid.uuid4().hex}"
        self.months: dict[str, list[str]] = {}

    def write(self, rows: DataFrame, table: str, month: str = "mes") -> int:
        """Write rows for the months they belong to; returns their number, counted by the write itself.

        One job: rows are rebalanced by month, which splits a large month over several tasks and files and
        joins small ones. Rows are counted after that, in the tasks that write, so a lost executor does
        not count any twice. An empty frame replaces nothing.
        """
        seen = Observation()
        counted = rows.hint("rebalance", F.col(month)).observe(seen, F.count(F.lit(1)).alias("rows"))
        path = f"{table}/version={self.version}"
        counted.write.partitionBy(month).parquet(f"{self.root}/{path}")
        names = Folder(self.spark, self.root).names(path)
        self.months.setdefault(table, []).extend(n.split("=", 1)[1] for n in names if n.startswith(f"{month}="))
        return seen.get["rows"]

    def publish(self) -> Snapshot:
        """Make all that was written current, in one step; months that nobody wrote stay as they are."""

        def change(tables: dict) -> dict:
            out = {t: dict(months) for t, months in tables.items()}
            for table, months in self.months.items():
                out.setdefault(table, {}).update(dict.fromkeys(months, self.version))
            return out

        return publish(self.spark, self.root, change)


def read_table(
    spark: SparkSession, root: str, table: str, fields: T.StructType, month: str = "mes", number: int | None = None
) -> DataFrame:
    """The current rows of ``table``, or those of state ``number``; months and columns are pruned at the scan.

    A frame keeps reading the state it was made from. A state names at most one folder per month.
    """
    state = snapshot(spark, root, number)
    if state is None:
        raise FileNotFoundError(f"no tables below {root}")
    months = state.tables.get(table, {})
    if not months:
        return spark.createDataFrame([], fields)
    base = f"{root.rstrip('/')}/{table}"
    paths = [f"{base}/version={version}/{month}={name}" for name, version in sorted(months.items())]
    return spark.read.schema(fields).option("basePath", base).parquet(*paths).select(*fields.names)


def roll_back(spark: SparkSession, root: str, number: int) -> Snapshot:
    """Make state ``number`` current again, as a new state: a roll back can be rolled back."""
    old = snapshot(spark, root, number)
    return publish(spark, root, lambda _: old.tables)


def expire(spark: SparkSession, root: str, keep: int = 2, hours: float = 24.0) -> list[str]:
    """Delete version folders that none of the last ``keep`` states names, and the files of older states.

    Folders changed within ``hours`` stay, as a change that is still being written has no state yet.
    Returns the deleted folders.
    """
    folder = Folder(spark, root)
    states = numbers(spark, root)
    kept = states[-keep:]
    named = {(t, v) for n in kept for t, months in snapshot(spark, root, n).tables.items() for v in months.values()}
    gone = []
    for table in folder.names():
        for name in folder.names(table) if not table.startswith("_") else []:
            path = f"{table}/{name}"
            old = name.startswith("version=") and time.time() - folder.changed(path) >= hours * 3600
            if old and (table, name.split("=", 1)[1]) not in named:
                folder.delete(path)
                gone.append(path)
    for n in states[: -keep or None]:
        folder.delete(f"{PUBLISHED}/{_name(n)}")
    return gone
