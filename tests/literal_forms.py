"""Literal formulations that the rewritten operators are checked against."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.grid import MINUTE_DIMS, minute_buckets, spread_over_minutes
from slotwise.sources.jobs import creation_between


def usage_by_minute_theta(
    spark: SparkSession,
    jobs: DataFrame,
    as_of: datetime,
    minutes: int = 1440,
    creation_lookback: timedelta = timedelta(hours=26),
    dims: Sequence[str] = MINUTE_DIMS,
) -> DataFrame:
    """The reference formulation of C19: grid LEFT JOIN jobs on the range condition.

    Catalyst plans this as a nested-loop join (every grid minute against
    every job), so it is here and not in the library.
    """
    grid = minute_buckets(spark, as_of, minutes)
    recent = jobs.filter(creation_between(jobs, as_of - creation_lookback, None, include_start=False))
    spread = spread_over_minutes(recent, as_of)
    cond = (spread["start_time"] >= grid["stb"]) & (
        F.coalesce(spread["end_time"], spread["start_time"]) < grid["etb"]
    )
    base = grid.join(spread, cond, "left").select("stb", *dims, "avg_slot_ms", "avg_bytes_processed")
    return (
        base.groupBy("stb", *dims)
        .agg(
            F.sum("avg_slot_ms").alias("total_slot_ms"),
            F.sum("avg_bytes_processed").alias("total_bytes_processed"),
        )
        .orderBy(F.desc("stb"))
    )
