"""Time buckets, bucket statistics, gap filling and percentiles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.time import time_bucket

BUCKET_AVERAGES = (
    ("average_elapsed_ms", "elapsed_ms"),
    ("average_waiting_ms", "target_waiting_ms"),
    ("average_slot_usage", "average_slot_usage"),
    ("average_unit_slot_usage", "unit_slot_usage"),
    ("average_pending_units", "pending_units"),
    ("average_completed_units", "completed_units"),
    ("average_active_units", "active_units"),
)


def with_bucket(df: DataFrame, seconds: int, ts: str = "ctime", out: str = "ctime_bucket") -> DataFrame:
    """Tumbling ``seconds``-long bucket of ``ts``."""
    return df.withColumn(out, time_bucket(F.col(ts), seconds))


def bucket_averages(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``count(1)`` and seven sample averages per key (partial aggregation)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("job_count_per_timebucket"),
        *[F.avg(src).alias(name) for name, src in BUCKET_AVERAGES],
    )


def bucket_series(spark: SparkSession, start: datetime, end: datetime, seconds: int) -> DataFrame:
    """Aligned bucket starts from ``start`` to ``end``, both ends included.

    Both ends are first floored to the bucket grid (``div`` on epoch seconds),
    then every ``seconds`` step in between is produced by ``spark.range`` - a
    distributed range, so nothing the size of the series passes the driver.
    """

    def floor_seconds(t: datetime) -> int:
        if t.tzinfo is None:
            t = t.replace(tzinfo=timezone.utc)
        s = int(t.timestamp() // 1)
        return int(s / seconds) * seconds  # div truncates toward zero

    lo, hi = floor_seconds(start), floor_seconds(end)
    if hi < lo:
        return spark.range(0).select(F.timestamp_seconds(F.col("id")).alias("ctime_bucket"))
    n = (hi - lo) // seconds + 1
    return spark.range(n).select(
        F.timestamp_seconds(F.lit(lo).cast("long") + F.col("id") * F.lit(seconds)).alias("ctime_bucket")
    )


def gap_fill(series: DataFrame, stats: DataFrame, key: str = "ctime_bucket") -> DataFrame:
    """Every bucket of ``series``, with the per-bucket statistics of ``stats``.

    ``stats`` must hold one row per bucket already aggregated with
    :func:`bucket_averages`.  The reference left-joins raw samples to the
    series and then counts rows, so an empty bucket reports a count of 1; this
    keeps that rule (``coalesce(count, 1)``) while joining only aggregated
    rows, one per bucket, instead of every sample.
    """
    joined = series.join(stats, key, "left")
    return joined.withColumn(
        "job_count_per_timebucket",
        F.coalesce(F.col("job_count_per_timebucket"), F.lit(1).cast("long")),
    )


def _percentile_expr(x: str, p: float, kind: str) -> Column:
    if kind == "disc":
        return F.expr(f"percentile_disc({float(p)!r}) WITHIN GROUP (ORDER BY `{x}`)")
    if kind == "cont":
        return F.expr(f"percentile_cont({float(p)!r}) WITHIN GROUP (ORDER BY `{x}`)")
    raise ValueError(f"kind must be 'disc' or 'cont', got {kind!r}")


def percentiles_by(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    ps: dict[str, float],
    kind: str = "disc",
) -> DataFrame:
    """Exact percentiles of ``x`` per group, NULLs ignored.

    The reference computes a windowed percentile over each partition and then
    collapses it with ``any_value``/``distinct``; a grouped aggregate gives the
    same numbers with partial aggregation (each task keeps value -> count, so
    memory follows the number of distinct values, not of rows).  Use
    :func:`slotwise.operators.percentiles.exact_percentile_disc` for a single
    group whose distinct values grow with the data.
    """
    aggs = [_percentile_expr(x, p, kind).cast("double").alias(name) for name, p in ps.items()]
    if keys:
        return df.groupBy(*keys).agg(*aggs)
    return df.agg(*aggs)
