"""Named report queries over a test-data folder.

Each entry takes ``(spark, sf_dir)``, derives the job history from that
folder's ``orders`` / ``lineitem`` / ``region`` tables
(:mod:`slotwise.sources.fixture`) and runs one report with parameters fixed
relative to the derivation's ``AS_OF``.  The time windows span the whole
derived history (creation times cover the 60 days before ``AS_OF``), so every
report works over the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise import settings as S
from slotwise.operators.daily import creation_day, days_between
from slotwise.operators.grid import usage_by_minute
from slotwise.plans import reports as P
from slotwise.schemas import JOB_SCALAR_COLUMNS
from slotwise.session import ensure_checkpoint_dir
from slotwise.sources import jobs as src
from slotwise.sources.fixture import AS_OF, Fixture, load_fixture, with_long_jobs, with_repeated_rows

# Fixed parameters of the registered queries (relative to the fixture's AS_OF).
WHOLE_HISTORY = timedelta(days=61)
WINDOW = S.Window(as_of=AS_OF, lookback=WHOLE_HISTORY)
GRID_MINUTES = 61 * 24 * 60
LOWER_P4_SLOT_LIMIT = 10_000_000

SETTINGS = {
    "spill_or_bytes_offenders": S.SpillOrBytesSettings(window=WINDOW),
    "slot_sample_offenders": S.SlotSampleSettings(window=WINDOW),
    "slot_utilization": S.UtilizationSettings(window=WINDOW),
    "resource_hog_jobs": S.ResourceHogSettings(window=WINDOW, threshold_maximum_slot_ms=LOWER_P4_SLOT_LIMIT),
    "slot_threshold_calibration": S.CalibrationSettings(window=WINDOW),
    "elapsed_by_bytes_bucket": S.ElapsedByBytesSettings(window=WINDOW),
    "minute_usage": S.MinuteUsageSettings(
        as_of=AS_OF, minutes=GRID_MINUTES, creation_lookback=WHOLE_HISTORY + timedelta(hours=2)
    ),
    "slot_bucket_indicator": S.IndicatorSettings(window=WINDOW),
    "monthly_slot_total": S.MonthlySettings(
        as_of=AS_OF, search_pending_time=timedelta(0), target_period=WHOLE_HISTORY
    ),
    "predicates": S.PredicateSettings(start_date=AS_OF - WHOLE_HISTORY, end_date=AS_OF),
    "bucket_series": S.BucketSeriesSettings(window=WINDOW),
}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    return load_fixture(spark, sf_dir)


# Reports that run over a history in which some job rows are there twice.
REPEATED = {
    "spill_or_bytes_offenders",
    "most_used_predicates",
    "most_used_predicates_project",
    "most_used_predicates_all_reads",
    "most_used_predicates_sizes",
    "predicate_listing",
    "duplicate_job_ids",
    "most_used_predicates_join",
    "predicate_listing_join",
    "slot_sample_offenders",
    "slot_sample_offenders_settings",
    "slot_utilization",
    "slot_utilization_window_lag",
    "resource_hog_jobs",
    "slot_threshold_calibration",
    "slot_bucket_indicator",
    "bucket_series",
    "bucket_series_window_lag",
    "bucket_series_from_days",
}


def _slot_utilization(spark: SparkSession, fx: Fixture) -> DataFrame:
    cat = fx.catalog
    return P.slot_utilization(fx.jobs, cat.assignments, cat.reservations, cat.tables, SETTINGS["slot_utilization"])


def _minute_usage_overlap(spark: SparkSession, fx: Fixture) -> DataFrame:
    """P7 by state, each job in all its minutes; some jobs last for weeks."""
    s = SETTINGS["minute_usage"]
    return usage_by_minute(spark, with_long_jobs(fx.jobs), AS_OF, s.minutes, s.creation_lookback, ("state",), "overlap")


def _bucket_series_from_days(spark: SparkSession, fx: Fixture) -> DataFrame:
    """P15 from stored days; one day was first written without some of its jobs, and is then replaced."""
    s = SETTINGS["bucket_series"]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/slotwise-days-{uuid.uuid4().hex[:12]}"
    days = days_between((AS_OF - WHOLE_HISTORY).date(), (AS_OF - timedelta(days=1)).date())
    late = days[len(days) // 2]
    on_time = ~((creation_day() == F.lit(late)) & (F.crc32("job_id") % 2 == 0))
    P.write_bucket_days(fx.jobs.filter(on_time), path, days, s)
    P.write_bucket_days(fx.jobs, path, [late], s)
    return P.bucket_series_from_days(spark, path, s)


# Reports over an already loaded fixture (jobs + catalog).
REPORTS: dict[str, Callable[[SparkSession, Fixture], DataFrame]] = {
    "spill_or_bytes_offenders": lambda spark, fx: P.spill_or_bytes_offenders(
        fx.jobs, SETTINGS["spill_or_bytes_offenders"]
    ),
    "slot_sample_offenders": lambda spark, fx: P.slot_sample_offenders(fx.jobs, SETTINGS["slot_sample_offenders"]),
    "slot_sample_offenders_settings": lambda spark, fx: P.slot_sample_offenders(
        fx.jobs, replace(SETTINGS["slot_sample_offenders"], echo_settings=True)
    ).withColumn("check_state", F.array_join("check_state", ",")),
    "slot_utilization": _slot_utilization,
    "resource_hog_jobs": lambda spark, fx: P.resource_hog_jobs(fx.jobs, SETTINGS["resource_hog_jobs"]),
    "slot_threshold_calibration": lambda spark, fx: P.slot_threshold_calibration(
        fx.jobs, SETTINGS["slot_threshold_calibration"]
    ),
    "elapsed_by_bytes_bucket": lambda spark, fx: P.elapsed_by_bytes_bucket(fx.jobs, SETTINGS["elapsed_by_bytes_bucket"]),
    "elapsed_by_bytes_bucket_total": lambda spark, fx: P.elapsed_by_bytes_bucket(
        fx.jobs, replace(SETTINGS["elapsed_by_bytes_bucket"], elapsed="total")
    ),
    "elapsed_by_bytes_raw": lambda spark, fx: P.elapsed_by_bytes_raw(fx.jobs, SETTINGS["elapsed_by_bytes_bucket"]),
    "minute_usage": lambda spark, fx: P.minute_usage(spark, fx.jobs, SETTINGS["minute_usage"]),
    "minute_usage_by_reservation": lambda spark, fx: P.minute_usage_by_reservation(
        spark, fx.jobs, SETTINGS["minute_usage"]
    ),
    "minute_usage_overlap": _minute_usage_overlap,
    "slot_bucket_indicator": lambda spark, fx: P.slot_bucket_indicator(fx.jobs, SETTINGS["slot_bucket_indicator"]),
    "monthly_slot_total": lambda spark, fx: P.monthly_slot_total(fx.jobs, SETTINGS["monthly_slot_total"]),
    "most_used_predicates": lambda spark, fx: P.most_used_predicates(fx.jobs, SETTINGS["predicates"]),
    "most_used_predicates_project": lambda spark, fx: P.most_used_predicates(
        fx.jobs, replace(SETTINGS["predicates"], project_id="proj-0")
    ),
    "most_used_predicates_sizes": lambda spark, fx: P.most_used_predicates_all_reads(
        fx.jobs, SETTINGS["predicates"], table_storage=fx.table_storage
    ),
    "most_used_predicates_all_reads": lambda spark, fx: P.most_used_predicates_all_reads(
        fx.jobs, SETTINGS["predicates"]
    ),
    "most_used_queries": lambda spark, fx: P.most_used_queries(fx.jobs),
    "most_used_queries_concise": lambda spark, fx: P.most_used_queries_concise(fx.jobs),
    "most_used_queries_spilled": lambda spark, fx: P.most_used_queries_spilled(fx.jobs),
    "predicate_listing": lambda spark, fx: P.predicate_listing(fx.jobs, SETTINGS["predicates"]),
    "bucket_series": lambda spark, fx: P.bucket_series(spark, fx.jobs, SETTINGS["bucket_series"]),
    "duplicate_job_ids": lambda spark, fx: P.duplicate_job_ids(fx.jobs),
    "missing_slot_jobs": lambda spark, fx: P.missing_slot_jobs(fx.jobs, JOB_SCALAR_COLUMNS),
    "job_timeline": lambda spark, fx: P.job_timeline(fx.jobs),
    # The reference formulations (window lags, plan joins, row_number) of
    # reports whose default form is rewritten; same results, same oracle.
    "slot_utilization_window_lag": lambda spark, fx: P.slot_utilization(
        fx.jobs,
        fx.catalog.assignments,
        fx.catalog.reservations,
        fx.catalog.tables,
        SETTINGS["slot_utilization"],
        method="window",
    ),
    "bucket_series_window_lag": lambda spark, fx: P.bucket_series(
        spark, fx.jobs, SETTINGS["bucket_series"], method="window"
    ),
    "bucket_series_from_days": _bucket_series_from_days,
    "most_used_predicates_join": lambda spark, fx: P.most_used_predicates(
        fx.jobs, SETTINGS["predicates"], method="join"
    ),
    "predicate_listing_join": lambda spark, fx: P.predicate_listing(fx.jobs, SETTINGS["predicates"], method="join"),
    "most_used_queries_row_number": lambda spark, fx: P.most_used_queries(fx.jobs, method="window"),
}

# Reference-formulation entries and the report whose oracle they share.
SAME_ORACLE = {
    "slot_utilization_window_lag": "slot_utilization",
    "bucket_series_window_lag": "bucket_series",
    "bucket_series_from_days": "bucket_series",
    "most_used_predicates_join": "most_used_predicates",
    "predicate_listing_join": "predicate_listing",
    "most_used_queries_row_number": "most_used_queries",
}


def _over_folder(report: Callable[[SparkSession, Fixture], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(spark, fixture(spark, sf_dir))

    return run


def _over_repeated(report: Callable[[SparkSession, Fixture], DataFrame]) -> Callable[[SparkSession, Fixture], DataFrame]:
    return lambda spark, fx: report(spark, replace(fx, jobs=with_repeated_rows(fx.jobs)))


REPORTS = {name: _over_repeated(report) if name in REPEATED else report for name, report in REPORTS.items()}


def export(spark: SparkSession, fx: Fixture) -> str:
    """Write the job history and the catalog tables as an export, into a new folder of the shared scratch folder."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/slotwise-export-{uuid.uuid4().hex[:12]}"
    cat = fx.catalog
    tables = {"jobs": fx.jobs, "tables": cat.tables, "assignments": cat.assignments, "reservations": cat.reservations}
    for name, df in (tables | {"storage": fx.table_storage}).items():
        df.write.parquet(f"{base}/{name}")
    return base


def _from_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 over an export, read by the readers."""
    fx = fixture(spark, sf_dir)
    base = export(spark, replace(fx, jobs=with_repeated_rows(fx.jobs)))
    return P.slot_utilization(
        src.read_jobs(spark, f"{base}/jobs"),
        src.read_assignments(spark, f"{base}/assignments"),
        src.read_reservations(spark, f"{base}/reservations"),
        src.read_tables(spark, f"{base}/tables"),
        SETTINGS["slot_utilization"],
    )


def _project_from_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 over one project's rows of an export."""
    fx = fixture(spark, sf_dir)
    base = export(spark, replace(fx, jobs=with_repeated_rows(fx.jobs)))
    return P.most_used_predicates(src.read_jobs(spark, f"{base}/jobs", project_id="proj-0"), SETTINGS["predicates"])


def _sizes_from_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 with table sizes over an export."""
    fx = fixture(spark, sf_dir)
    base = export(spark, replace(fx, jobs=with_repeated_rows(fx.jobs)))
    storage = src.read_table_storage(spark, f"{base}/storage")
    return P.most_used_predicates_all_reads(src.read_jobs(spark, f"{base}/jobs"), SETTINGS["predicates"], table_storage=storage)


FROM_EXPORT = {
    "slot_utilization_from_export": _from_export,
    "most_used_predicates_project_from_export": _project_from_export,
    "most_used_predicates_sizes_from_export": _sizes_from_export,
}
# They share the oracle of the report without the suffix.
SAME_ORACLE |= {name: name.removesuffix("_from_export") for name in FROM_EXPORT}


# Reports over a test-data folder: (spark, sf_dir) -> DataFrame.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _over_folder(report) for name, report in REPORTS.items()
} | FROM_EXPORT


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column to ``digits`` decimals as ``round(x * 10^d) / 10^d``.

    Sums and averages of doubles depend on summation order in the last bits;
    comparing against another engine needs a common rounding, written the
    same way on both sides.
    """
    scale = float(10**digits)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name) * F.lit(scale)) / F.lit(scale)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
