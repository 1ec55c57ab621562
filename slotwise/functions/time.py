"""Time helpers, expressed with built-in Column functions only.

Millisecond offsets and differences keep the reference semantics:

* ``ms_between(a, b)`` is ``b - a`` in whole milliseconds, truncated toward zero.
* ``to_long_half_away`` is the integer cast of the reference dialect, which
  rounds half away from zero (a plain Spark cast truncates).
* ``time_bucket(ts, n)`` is the tumbling bucket
  ``timestamp_seconds(div(unix_seconds(ts), n) * n)`` (``div`` truncates).
* Minute truncation is done on epoch seconds, which equals truncation in any
  zone whose offset is a whole number of minutes (such as the reference's
  UTC+9), and does not depend on the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(value: datetime) -> Column:
    """Timestamp literal; naive datetimes are taken as UTC."""
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    micros = int(round(value.timestamp() * 1_000_000))
    return F.timestamp_micros(F.lit(micros))


def ms_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from ``start`` to ``end`` (negative if end is earlier)."""
    return F.timestamp_diff("MILLISECOND", start, end)


def add_ms(ts: Column, ms: Column) -> Column:
    return F.timestamp_add("MILLISECOND", ms, ts)


def to_long_half_away(x: Column) -> Column:
    """Integer cast that rounds half away from zero."""
    return F.round(x).cast("long")


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the ``seconds``-long tumbling bucket holding ``ts``."""
    s = F.unix_seconds(ts)
    return F.timestamp_seconds(s - s % F.lit(int(seconds)))


def trunc_minute(ts: Column) -> Column:
    return time_bucket(ts, 60)


def minute_field(start_minute: Column, end_minute: Column) -> Column:
    """Minute field (0-59 for a non-negative gap) of ``end - start``.

    The reference extracts the MINUTE part of an interval, which wraps at one
    hour; both inputs are whole minutes.
    """
    minutes = F.timestamp_diff("MINUTE", start_minute, end_minute)
    return minutes % F.lit(60)
