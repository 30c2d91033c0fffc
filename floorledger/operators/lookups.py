"""Joining a large frame with a side that is usually small, without assuming that it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and their size as text, added up on the executors; two numbers reach the driver."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return row["rows"], row["bytes"]


def lookup_join(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
    size: int | None = None,
) -> DataFrame:
    """Join ``large`` with ``small`` on ``on``; ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.

    ``small`` is measured, unless its ``size`` in bytes is given. Below ``broadcast_bytes`` it is broadcast
    and ``large`` is not shuffled. Above it, both sides are shuffled on the keys; a key that holds a third
    of all rows is split over tasks by adaptive execution, which works for all of these joins as ``large``
    is on the left. Both ways give the same rows and read only the columns they need.
    """
    if size is None:
        size = measure(small)[1]
    return large.join(F.broadcast(small) if size <= broadcast_bytes else small.hint("merge"), on, how)
