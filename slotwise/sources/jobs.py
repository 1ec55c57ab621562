"""Readers for the job-history export and the capacity catalog.

Each reader is a plain ``spark.read`` with an explicit schema, so Catalyst
prunes nested columns and pushes ``creation_time`` / ``state`` filters into the
Parquet scan.  Store job history partitioned by creation date to get partition
pruning on top.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise import schemas
from slotwise.functions.time import ts_lit

# Optional date partition column of a job-history export.
PARTITION_COLUMN = "creation_date"


def read_jobs(
    spark: SparkSession,
    path: str,
    project_id: str | None = None,
    partitioned_by_date: bool = False,
) -> DataFrame:
    """Job history, optionally restricted to one project.

    ``partitioned_by_date`` reads an export laid out as
    ``path/creation_date=YYYY-MM-DD/``; the reports then add a date-range
    filter on that column (see :func:`creation_between`), so only the
    partitions of the time window are listed and read.
    """
    schema = schemas.JOBS
    if partitioned_by_date:
        schema = T.StructType(schema.fields + [T.StructField(PARTITION_COLUMN, T.DateType())])
    df = spark.read.schema(schema).parquet(path)
    if project_id is not None:
        df = df.filter(F.col("project_id") == F.lit(project_id))
    return df


def _utc_date(t: datetime):
    if t.tzinfo is None:
        t = t.replace(tzinfo=timezone.utc)
    return t.astimezone(timezone.utc).date()


def creation_between(
    jobs: DataFrame,
    start: datetime | None,
    end: datetime | None,
    include_start: bool = True,
) -> Column:
    """Condition ``start <= creation_time <= end`` (``>`` when ``include_start`` is false).

    When the DataFrame carries the ``creation_date`` partition column, a
    date-range condition on it is added: Spark does not derive partition
    filters from a filter on ``creation_time``, so without it every
    partition would be listed and opened.  The date range is widened by a
    day on each side, so it holds whatever zone the partitions were written
    in; the exact ``creation_time`` condition still decides.
    """
    t = F.col("creation_time")
    cond = F.lit(True)
    if start is not None:
        cond = cond & ((t >= ts_lit(start)) if include_start else (t > ts_lit(start)))
    if end is not None:
        cond = cond & (t <= ts_lit(end))
    if PARTITION_COLUMN in jobs.columns:
        d = F.col(PARTITION_COLUMN)
        if start is not None:
            cond = cond & (d >= F.lit(_utc_date(start) - timedelta(days=1)))
        if end is not None:
            cond = cond & (d <= F.lit(_utc_date(end) + timedelta(days=1)))
    return cond


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Table catalog (S3)."""
    return spark.read.schema(schemas.TABLES).parquet(path)


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """Reservation assignments."""
    return spark.read.schema(schemas.ASSIGNMENTS).parquet(path)


def read_reservations(spark: SparkSession, path: str) -> DataFrame:
    """Reservation capacities."""
    return spark.read.schema(schemas.RESERVATIONS).parquet(path)


def read_table_storage(spark: SparkSession, path: str) -> DataFrame:
    """Table sizes (S6), used by the optional size columns of P12."""
    return spark.read.schema(schemas.TABLE_STORAGE).parquet(path)
