"""Per-minute usage of finished jobs, incrementally (Structured Streaming form of P7/P8).

The batch report assigns a finished job to the minute it starts in, and only
if it also ends in that minute (``trunc(end) == trunc(start)``; a job that
crosses a minute boundary is not counted, and its whole slot-ms go to that
minute since the minute count is 1).  For such jobs the start minute *is* the
end minute, so the stream is windowed on ``end_time`` - the time at which a
finished-job record appears - with a watermark on the same column; each
minute is emitted once, in append mode, when the watermark passes it.

Running jobs have no final values yet and are not part of this stream; the
batch report over a snapshot covers them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.time import trunc_minute
from slotwise.operators.grid import MINUTE_DIMS


def finished_minute_usage(
    finished_jobs: DataFrame,
    dims: Sequence[str] = MINUTE_DIMS,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Streaming (or batch) DataFrame of ``stb``, ``dims``, slot-ms and bytes per minute.

    ``finished_jobs`` is a stream of job records with ``end_time`` set.
    """
    same_minute = finished_jobs.filter(
        F.col("end_time").isNotNull()
        & F.col("start_time").isNotNull()
        & (trunc_minute(F.col("end_time")) == trunc_minute(F.col("start_time")))
    )
    windowed = (
        same_minute.withWatermark("end_time", watermark)
        .groupBy(F.window("end_time", "1 minute").alias("w"), *dims)
        .agg(
            F.sum(F.col("total_slot_ms") / F.lit(1.0)).alias("total_slot_ms"),
            F.sum(F.col("total_bytes_processed") / F.lit(1.0)).alias("total_bytes_processed"),
        )
    )
    return windowed.select(F.col("w.start").alias("stb"), *dims, "total_slot_ms", "total_bytes_processed")


def start_minute_usage_stream(
    finished_jobs: DataFrame,
    checkpoint_location: str,
    sink_format: str = "parquet",
    path: str | None = None,
    query_name: str | None = None,
    dims: Sequence[str] = MINUTE_DIMS,
    watermark: str = "10 minutes",
    trigger: dict | None = None,
):
    """Start the incremental report; returns the ``StreamingQuery``.

    ``checkpoint_location`` must be a shared, fault-tolerant folder on a
    cluster (the query restarts from it after a failure).
    """
    out = finished_minute_usage(finished_jobs, dims, watermark)
    writer = (
        out.writeStream.outputMode("append")
        .format(sink_format)
        .option("checkpointLocation", checkpoint_location)
    )
    if path is not None:
        writer = writer.option("path", path)
    if query_name is not None:
        writer = writer.queryName(query_name)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()
