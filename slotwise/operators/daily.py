"""Bucket statistics kept per day and merged (C22, C23): a series that grows by a day without reading the history again.

A day's state holds, per time bucket, the number of samples and each measure's sum and count, so
states of different days merge by adding up; averages are formed only when a series is read.  States
are Parquet, partitioned by the jobs' creation date:

* writing days replaces exactly those days' partitions (dynamic partition overwrite), so a
  rerun or a late day gives the same state as a first write, whatever was there before;
* each written day has a row of its own without a bucket.  A day whose jobs are all gone is thereby replaced, too, and a
  day that was never written is told from a day without jobs when the states are read.

A bucket may get samples from jobs of several days.  All rows of a job id have to
lie on one creation date, as lags are taken inside a day's jobs.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.buckets import BUCKET_AVERAGES

DAY = "creation_date"


def days_between(first: date, last: date) -> list[date]:
    """All days from ``first`` to ``last``, both included."""
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def creation_day() -> Column:
    """The UTC day of ``creation_time``, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds("creation_time") / F.lit(86400)).cast("int"))


def bucket_states(samples: DataFrame, key: str = "ctime_bucket") -> DataFrame:
    """Per creation date and bucket: ``samples`` and, for each average of C22, ``sum_<name>`` and ``count_<name>``.

    ``samples`` has the columns of C22 and ``creation_time``.  Whole numbers are summed
    exactly, as decimals; the sums are reduced in each task before the shuffle.
    """
    kinds = dict(samples.dtypes)
    aggs = [F.count(F.lit(1)).alias("samples")]
    for name, column in BUCKET_AVERAGES:
        x = F.col(column)
        x = x.cast("double") if kinds[column] in ("double", "float") else x.cast("decimal(20,0)")
        aggs += [F.sum(x).alias(f"sum_{name}"), F.count(column).alias(f"count_{name}")]
    return samples.groupBy(creation_day().alias(DAY), key).agg(*aggs)


def write_days(states: DataFrame, path: str, days: Iterable[date], key: str = "ctime_bucket") -> None:
    """Replace the partitions of ``days`` below ``path`` by those days' rows of ``states``.

    Days of ``states`` that are not in ``days`` are left alone.
    """
    spark, days = states.sparkSession, sorted(set(days))
    if not days:
        return
    marks = spark.createDataFrame([(d,) for d in days], f"{DAY} date")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in states.schema.fields if f.name != DAY]
    rows = states.filter(F.col(DAY).isin(days)).unionByName(marks.select(DAY, *empty))
    rows.repartitionByRange(DAY, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def read_days(spark: SparkSession, path: str, first: date, last: date, key: str = "ctime_bucket") -> DataFrame:
    """The states of the days from ``first`` to ``last``; an error if one of them was never written."""
    states = spark.read.parquet(path).filter(F.col(DAY).between(F.lit(first), F.lit(last)))
    written = {r[DAY] for r in states.filter(F.col(key).isNull() & F.col("samples").isNull()).select(DAY).distinct().collect()}
    missing = [str(d) for d in days_between(first, last) if d not in written]
    if missing:
        raise ValueError(f"days without a written state: {', '.join(missing)}")
    return states.filter(F.col("samples").isNotNull())


def merged_averages(states: DataFrame, key: str = "ctime_bucket") -> DataFrame:
    """C22 from states: one row per bucket, with the columns of :func:`slotwise.operators.buckets.bucket_averages`."""
    sums = [F.sum("samples").alias("job_count_per_timebucket")]
    for name, _ in BUCKET_AVERAGES:
        count = F.sum(f"count_{name}")
        sums.append(F.when(count > 0, F.sum(f"sum_{name}").cast("double") / count).alias(name))
    return states.groupBy(key).agg(*sums)
