"""The bucket series from stored days against the series straight from the jobs."""

from __future__ import annotations

import os
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from builders import job, jobs_df, sample
from oracle_compare import normalized_rows
from slotwise import settings as S
from slotwise.operators import daily as D
from slotwise.plans import reports as P
from slotwise.plans.registry import round_doubles

END = datetime(2024, 2, 4, tzinfo=timezone.utc)
SETTINGS = S.BucketSeriesSettings(window=S.Window(as_of=END, lookback=timedelta(days=3), lag=timedelta(0)), bucket_time=3600)
DAYS = D.days_between(date(2024, 2, 1), date(2024, 2, 3))


def made(day: int, hour: int, name: str, lasts=(1000, 4000)):
    created = datetime(2024, 2, day, hour, tzinfo=timezone.utc)
    line = [sample(ms, ms * (i + 3), pending=i, completed=None if i else 7, active=hour) for i, ms in enumerate(lasts)]
    return job(name, creation_time=created, start_time=created + timedelta(seconds=day), end_time=None, state="DONE", timeline=line)


HISTORY = [
    made(1, 0, "a"),
    made(1, 23, "late", lasts=(1000, 7_200_000, 90_000_000)),  # samples on the second and third day
    made(2, 23, "b"),
    made(2, 5, "twice"),
    made(2, 5, "twice"),
    made(3, 23, "c", lasts=()),
    job("unstarted", creation_time=datetime(2024, 2, 2, 7, tzinfo=timezone.utc), start_time=None, timeline=[sample(5, 5)]),
]


def same(a, b):
    assert a.columns == b.columns
    assert normalized_rows(a.columns, round_doubles(a).collect()) == normalized_rows(b.columns, round_doubles(b).collect())


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "days")


def test_stored_days_equal_the_direct_series(spark, path):
    jobs = jobs_df(spark, HISTORY)
    for day in DAYS:  # one run a day
        P.write_bucket_days(jobs, path, [day], SETTINGS)
    want = P.bucket_series(spark, jobs, SETTINGS)
    assert want.filter("average_elapsed_ms is not null").count() > 4
    same(P.bucket_series_from_days(spark, path, SETTINGS), want)


def test_a_late_day_is_replaced_and_the_others_are_left_alone(spark, path):
    jobs = jobs_df(spark, HISTORY)
    P.write_bucket_days(jobs_df(spark, HISTORY[:2]), path, DAYS, SETTINGS)
    first_day = os.path.join(path, "creation_date=2024-02-01")
    before = sorted(os.listdir(first_day))
    for _ in range(2):  # a rerun changes nothing
        P.write_bucket_days(jobs, path, DAYS[1:], SETTINGS)
        same(P.bucket_series_from_days(spark, path, SETTINGS), P.bucket_series(spark, jobs, SETTINGS))
    assert sorted(os.listdir(first_day)) == before


def test_a_day_whose_jobs_are_gone_is_emptied(spark, path):
    P.write_bucket_days(jobs_df(spark, HISTORY), path, DAYS, SETTINGS)
    rest = jobs_df(spark, [r for r in HISTORY if r[7].day != 2])
    P.write_bucket_days(rest, path, [DAYS[1]], SETTINGS)
    same(P.bucket_series_from_days(spark, path, SETTINGS), P.bucket_series(spark, rest, SETTINGS))


def test_days_that_were_never_written_are_an_error(spark, path):
    P.write_bucket_days(jobs_df(spark, HISTORY).limit(0), path, [DAYS[0], DAYS[2]], SETTINGS)
    with pytest.raises(ValueError, match="2024-02-02"):
        P.bucket_series_from_days(spark, path, SETTINGS)
    P.write_bucket_days(jobs_df(spark, HISTORY).limit(0), path, [DAYS[1]], SETTINGS)
    assert P.bucket_series_from_days(spark, path, SETTINGS).filter("average_elapsed_ms is not null").count() == 0


def test_windows_have_to_be_whole_days(spark, path):
    half = S.BucketSeriesSettings(window=S.Window(as_of=END + timedelta(hours=1), lookback=timedelta(days=3)))
    with pytest.raises(ValueError, match="midnight"):
        P.bucket_series_from_days(spark, path, half)


def test_only_the_days_that_are_read_are_scanned(spark, path):
    P.write_bucket_days(jobs_df(spark, HISTORY), path, DAYS, SETTINGS)
    plan = D.read_days(spark, path, DAYS[1], DAYS[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(creation_date" in plan
    assert D.read_days(spark, path, DAYS[1], DAYS[1]).filter(F.col("creation_date") != F.lit(DAYS[1])).count() == 0
