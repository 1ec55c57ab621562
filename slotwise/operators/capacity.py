"""Purchased capacity and utilization scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UTILIZATION_COLUMNS = (
    "sum_waiting_ms",
    "sum_average_slot_usage",
    "sum_unit_slot_usage",
    "sum_pending_units",
    "sum_completed_units",
    "sum_active_units",
)


def default_project(tables: DataFrame) -> DataFrame:
    """One-row project choice: the smallest ``table_catalog``.

    The reference takes an arbitrary row (``distinct ... limit 1``); the
    smallest value makes the choice reproducible.
    """
    return tables.agg(F.min("table_catalog").alias("project_id"))


def slot_capacity(
    assignments: DataFrame,
    reservations: DataFrame,
    project: DataFrame,
    job_type: str = "QUERY",
) -> DataFrame:
    """One row ``sum_slot_capacity`` of the reservations assigned to the project.

    ``project`` is a single row (a global aggregate or a literal), so it is
    broadcast explicitly.  The reservation catalog is left to the planner:
    AQE broadcasts it only when its measured size is under the threshold.
    The global aggregate always returns exactly one row.
    """
    a = assignments.filter(F.col("job_type") == F.lit(job_type)).select(
        "reservation_name", "assignee_id"
    )
    a = a.join(F.broadcast(project), a["assignee_id"] == project["project_id"], "inner")
    r = reservations.select("reservation_name", "slot_capacity")
    joined = a.join(r, "reservation_name", "inner")
    return joined.agg(F.sum("slot_capacity").alias("sum_slot_capacity"))


def utilization(stat: DataFrame, capacity: DataFrame, bucket_time: int) -> DataFrame:
    """Per-second values and percent of capacity, ordered by bucket.

    ``capacity`` is the one-row result of :func:`slot_capacity` (a global
    aggregate, so its size is fixed at one row) and is broadcast.
    """
    n = F.lit(int(bucket_time))
    cap = F.col("sum_slot_capacity")
    joined = stat.crossJoin(F.broadcast(capacity))
    return joined.select(
        "ctime_bucket",
        (F.col("sum_waiting_ms") / n).alias("sum_waiting_ms"),
        (F.col("sum_average_slot_usage") / n * F.lit(100) / cap).alias("sum_average_slot_usage"),
        (F.col("sum_unit_slot_usage") / n * F.lit(100) / cap).alias("sum_unit_slot_usage"),
        (F.col("sum_pending_units") / n).alias("sum_pending_units"),
        (F.col("sum_completed_units") / n).alias("sum_completed_units"),
        (F.col("sum_active_units") / n).alias("sum_active_units"),
    ).orderBy(F.asc_nulls_first("ctime_bucket"))
