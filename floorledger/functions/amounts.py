"""Amount expressions: reading amounts from text and adding them up exactly.

Amounts are doubles that hold whole cents. Adding doubles makes totals depend on the order rows arrive
in, and adding decimals costs about ten times more than adding longs (the sum's buffer no longer fits a
machine word). So each amount is taken apart into whole units and cents, added as two longs, and put
together once per group. A value that is not whole cents, or is too large for that, or is infinite goes
into a third, double, total: nothing is rounded away and no row can overflow a cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorledger.functions.text import ASCII_SPACE, strip

NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
INFINITE = r"(?i)^[+-]?inf(?:inity)?$"

# Below this many cents, a double holds every cent.
EXACT_CENTS = 9.0e15

UNITS, CENTS, REST = "amt_units", "amt_cents", "amt_rest"
PARTS = [UNITS, CENTS, REST]


def parse_amount(text: Column, default: float | None = 0.0) -> Column:
    """Number in ``text``; ``default`` for null, thousands separators, currency signs and other text."""
    trimmed = strip(text, ASCII_SPACE)
    finite = F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))
    infinite = F.when(trimmed.rlike(INFINITE), trimmed.try_cast("double"))
    in_range = F.when(F.abs(finite) < F.lit(float("inf")), finite)
    return F.coalesce(in_range, infinite, F.lit(default).cast("double"))


def amount_parts(amount: Column) -> list[Column]:
    """Columns ``amt_units``, ``amt_cents``, ``amt_rest`` of one amount."""
    cents = F.rint(amount * 100)
    exact = (cents / F.lit(100.0) == amount) & (F.abs(cents) < EXACT_CENTS)
    units = F.floor(cents / F.lit(100.0))
    return [
        F.when(exact, units).alias(UNITS),
        F.when(exact, cents.cast("bigint") - units * 100).alias(CENTS),
        F.when(~exact, amount).alias(REST),
    ]


def sum_parts(condition: Column | None = None) -> list[Column]:
    """Aggregates that keep the three parts, for further adding."""
    return [F.sum(_when(condition, F.col(p))).alias(p) for p in PARTS]


def sum_amount(condition: Column | None = None) -> Column:
    """Total as a double; 0.0 when no row takes part."""
    units, cents, rest = (F.sum(_when(condition, F.col(p))) for p in PARTS)
    exact = units.cast("decimal(20,0)") + cents.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")
    return F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))


def _when(condition: Column | None, value: Column) -> Column:
    return value if condition is None else F.when(condition, value)
