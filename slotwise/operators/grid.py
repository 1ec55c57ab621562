"""Per-minute usage grid.

The reference left-joins a grid of ``[stb, etb)`` minutes to jobs with the
range condition ``start_time >= stb and ifnull(end_time, start_time) < etb``.
For a job with ``e = ifnull(end_time, start_time)`` that condition holds for
exactly the grid minutes ``m`` with ``trunc(e) <= m <= trunc(start_time)``:
a single minute when the job starts and ends inside it, none when it crosses a
minute boundary (and several only for inconsistent rows with ``e`` before the
start).  So instead of a nested-loop range join, each job is expanded to that
(usually empty or one-element) minute sequence, clipped to the grid, the
usage is aggregated per minute, and only the aggregate meets the grid in an
equi-join.

``match="overlap"`` counts a job in all its minutes, which may be 43,200 for a
job of 30 days.  There a job is two rows, whatever its length: its shares are added at
its first minute and taken off after its last one, and running sums over the minutes
give the usage (:func:`usage_over_spans`).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions.time import minute_field, trunc_minute, ts_lit
from slotwise.sources.jobs import creation_between

MINUTE_DIMS = ("project_id", "job_type", "statement_type", "priority", "state")

#: Minutes of a block; running sums are taken inside blocks, and over the blocks' totals.
BLOCK = 24 * 60
#: Parts of a unit in which shares are summed, as integers: sums do not depend on order and cancel exactly.
PARTS = 1_000_000


def _floor_minute(t: datetime) -> datetime:
    return t - timedelta(seconds=t.second, microseconds=t.microsecond)


def minute_buckets(spark: SparkSession, as_of: datetime, minutes: int = 1440) -> DataFrame:
    """C17: ``stb``/``etb`` for the ``minutes`` whole minutes up to ``as_of``.

    ``stb = trunc(as_of) - t0 minutes`` for ``t0 = 0 .. minutes-1`` and
    ``etb = stb + 1 minute``; generated with a distributed ``spark.range``.
    """
    top = int(_floor_minute(as_of).timestamp())
    stb = F.timestamp_seconds(F.lit(top).cast("long") - F.col("id") * F.lit(60))
    return spark.range(int(minutes)).select(
        stb.alias("stb"),
        F.timestamp_seconds(F.lit(top).cast("long") - (F.col("id") - F.lit(1)) * F.lit(60)).alias("etb"),
    )


def spread_over_minutes(jobs: DataFrame, as_of: datetime) -> DataFrame:
    """Start minute, ``minbucket_count`` and per-minute averages.

    ``minbucket_count`` is the MINUTE field of
    ``trunc(ifnull(end_time, as_of)) - trunc(start_time)`` plus one (the field
    wraps every hour, as in the reference).
    """
    smin = trunc_minute(F.col("start_time"))
    end_for_count = F.coalesce(F.col("end_time"), ts_lit(as_of))
    count = minute_field(smin, trunc_minute(end_for_count)).cast("double") + F.lit(1.0)
    return jobs.withColumns(
        {
            "smin": smin,
            "minbucket_count": count,
        }
    ).withColumns(
        {
            "avg_slot_ms": F.col("total_slot_ms") / F.col("minbucket_count"),
            "avg_bytes_processed": F.col("total_bytes_processed") / F.col("minbucket_count"),
        }
    )


def _epoch_minute(t: Column) -> Column:
    return F.floor(F.unix_seconds(t) / F.lit(60)).cast("long")


def _share(total: str, minutes: Column) -> Column:
    """``total / minutes`` in whole :data:`PARTS`, rounded towards zero."""
    x = F.col(total).cast("long")
    whole, rest = F.call_function("div", x, minutes), x % minutes
    part = F.call_function("div", rest * F.lit(PARTS), minutes)
    return (whole.cast("decimal(19,0)") * F.lit(PARTS) + part).cast("decimal(28,0)")


def usage_over_spans(spans: DataFrame, dims: Sequence[str], measures: Sequence[str], first: int, last: int) -> DataFrame:
    """(``_minute``, dims..., measures...): what the rows of ``spans`` add up to in each minute that one of them covers.

    A row covers the epoch minutes ``_lo`` to ``_hi`` and adds its measures (integers or NULL) to each;
    a sum over NULLs alone is NULL.  Only minutes from ``first`` to ``last`` are returned.

    Each row is two changes, merged per (dims, minute) before they are shuffled.  Minutes lie in blocks of
    :data:`BLOCK`: the blocks' totals, at most one row per (dims, block), are summed up
    first and enter each later block as a change at its beginning, so the running sums of
    all blocks are independent of one another and no task holds more than a block of a hot group.
    """
    dims, names = list(dims), ["_n", *(f"_{kind}_{m}" for m in measures for kind in ("sum", "known"))]
    lo, hi = F.greatest(F.col("_lo"), F.lit(first)), F.least(F.col("_hi"), F.lit(last))
    changes = F.array(F.struct(lo.alias("at"), F.lit(1).alias("sign")), F.struct((hi + 1).alias("at"), F.lit(-1).alias("sign")))
    rows = spans.filter(lo <= hi).select(*dims, *measures, F.explode(changes).alias("_change"))
    rows = rows.withColumns({"_minute": F.col("_change.at"), "_sign": F.col("_change.sign")}).filter(F.col("_minute") <= last)
    sums = [F.sum("_sign").alias("_n")]
    for m in measures:
        sums += [F.sum(F.col(m) * F.col("_sign")).alias(f"_sum_{m}"), F.sum(F.when(F.col(m).isNotNull(), F.col("_sign"))).alias(f"_known_{m}")]
    merged = rows.groupBy(*dims, "_minute").agg(*sums).withColumn("_block", F.floor(F.col("_minute") / F.lit(BLOCK)).cast("long"))

    order = Window.partitionBy(*dims).orderBy("_block")
    totals = merged.groupBy(*dims, "_block").agg(*(F.sum(c).alias(c) for c in names))
    totals = totals.select(*dims, "_block", F.lead("_block").over(order).alias("_next"), *(F.sum(c).over(order).alias(c) for c in names))
    until = F.coalesce(F.col("_next"), F.lit(last // BLOCK))
    later = totals.filter((F.col("_n") > 0) & (F.col("_block") < until)).withColumn("_block", F.explode(F.sequence(F.col("_block") + 1, until)))
    carried = later.select(*dims, (F.col("_block") * BLOCK).alias("_minute"), *names, "_block")

    both = merged.select(*carried.columns).unionByName(carried).repartition(*dims, "_block")
    both = both.groupBy(*dims, "_block", "_minute").agg(*(F.sum(c).alias(c) for c in names))
    inside = Window.partitionBy(*dims, "_block").orderBy("_minute")
    end = F.coalesce(F.lead("_minute").over(inside), F.least((F.col("_block") + 1) * BLOCK, F.lit(last + 1))) - 1
    runs = both.select(*dims, "_minute", end.alias("_end"), *(F.sum(c).over(inside).alias(c) for c in names)).filter("_n > 0")
    known = [F.when(F.col(f"_known_{m}") > 0, F.col(f"_sum_{m}")).alias(m) for m in measures]
    return runs.select(F.explode(F.sequence("_minute", "_end")).alias("_minute"), *dims, *known)


def _usage_overlapping(spread: DataFrame, as_of: datetime, first: datetime, last: datetime, dims: Sequence[str]) -> DataFrame:
    """Slot-ms and bytes per minute and dimension, each job spread evenly over its minutes up to its end or ``as_of``."""
    lo, hi = _epoch_minute(F.col("start_time")), _epoch_minute(F.coalesce(F.col("end_time"), ts_lit(as_of)))
    spans = spread.select(*dims, "total_slot_ms", "total_bytes_processed", lo.alias("_lo"), hi.alias("_hi"))
    minutes = F.greatest(F.col("_hi") - F.col("_lo") + 1, F.lit(1))
    spans = spans.select(*dims, "_lo", "_hi", _share("total_slot_ms", minutes).alias("_slot"), _share("total_bytes_processed", minutes).alias("_bytes"))
    used = usage_over_spans(spans, dims, ["_slot", "_bytes"], int(first.timestamp()) // 60, int(last.timestamp()) // 60)
    return used.select(
        F.timestamp_seconds(F.col("_minute") * 60).alias("stb"),
        *dims,
        (F.col("_slot").cast("double") / F.lit(float(PARTS))).alias("total_slot_ms"),
        (F.col("_bytes").cast("double") / F.lit(float(PARTS))).alias("total_bytes_processed"),
    )


def usage_by_minute(
    spark: SparkSession,
    jobs: DataFrame,
    as_of: datetime,
    minutes: int = 1440,
    creation_lookback: timedelta = timedelta(hours=26),
    dims: Sequence[str] = MINUTE_DIMS,
    match: str = "reference",
) -> DataFrame:
    """Slot-ms and bytes per grid minute and dimension, newest minute first.

    ``match="reference"`` keeps the reference's join rule (a finished job
    counts only if it starts and ends in the same minute; a running job only
    in its start minute).  ``match="overlap"`` instead spreads every job over
    all grid minutes from its start minute to its end minute (``as_of`` when
    running), dividing by the true number of minutes; a job's share of a minute is
    counted in whole millionths.
    """
    grid = minute_buckets(spark, as_of, minutes)
    top = _floor_minute(as_of)
    first = top - timedelta(minutes=int(minutes) - 1)

    recent = jobs.filter(creation_between(jobs, as_of - creation_lookback, None, include_start=False))
    # A job that has not started is in no minute (greatest and least below skip NULLs).
    started = recent.filter(F.col("start_time").isNotNull())
    if match == "overlap":
        per_minute = _usage_overlapping(started, as_of, first, top, dims)
    elif match == "reference":
        per_minute = _usage_in_one_minute(spread_over_minutes(started, as_of), first, top, dims)
    else:
        raise ValueError(f"match must be 'reference' or 'overlap', got {match!r}")
    out = grid.select("stb").join(per_minute, "stb", "left")
    return out.select("stb", *dims, "total_slot_ms", "total_bytes_processed").orderBy(F.desc("stb"))


def _usage_in_one_minute(spread: DataFrame, first: datetime, last: datetime, dims: Sequence[str]) -> DataFrame:
    """Slot-ms and bytes per minute and dimension by the reference's join rule."""
    lo_c = F.greatest(trunc_minute(F.coalesce(F.col("end_time"), F.col("start_time"))), ts_lit(first))
    hi_c = F.least(F.col("smin"), ts_lit(last))
    minutes_hit = F.when(
        lo_c <= hi_c, F.sequence(lo_c, hi_c, F.expr("INTERVAL 1 MINUTE"))
    )
    matched = spread.filter(lo_c <= hi_c).select(
        F.explode(minutes_hit).alias("stb"), *dims, "avg_slot_ms", "avg_bytes_processed"
    )
    return matched.groupBy("stb", *dims).agg(
        F.sum("avg_slot_ms").alias("total_slot_ms"),
        F.sum("avg_bytes_processed").alias("total_bytes_processed"),
    )
