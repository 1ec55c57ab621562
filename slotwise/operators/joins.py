"""Join sides of unknown size: broadcast only after counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow join side (ids, counts) is broadcast.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """``df``, marked for broadcast if it has at most ``limit`` rows, and its rows counted up to ``limit + 1``.

    The count is a job of its own; beyond the limit the join shuffles both sides.
    """
    rows = df.limit(limit + 1).count()
    return (F.broadcast(df) if rows <= limit else df), rows
