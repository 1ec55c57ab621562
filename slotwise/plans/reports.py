"""The reports (P1-P18), each a DataFrame -> DataFrame composition of operators.

Every function takes the job-history DataFrame (plus catalog tables where
needed) and a settings dataclass, and returns a DataFrame.  Most are not
evaluated before they are used; P1, P11, P12, P14 and P13 first count narrow rows to
choose a join, and P5, P9 and P6 over total times select percentiles from written values.
``method="array"`` (default) computes per-job lags inside the timeline array
with no shuffle; ``method="window"`` is the reference's window formulation.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise import settings as S
from slotwise.functions.buckets import bucket_label, range_bucket, sign_floor_bucket
from slotwise.functions.time import ms_between, ts_lit
from slotwise.operators import buckets as B
from slotwise.operators import capacity as C
from slotwise.operators import daily as D
from slotwise.operators import grid as G
from slotwise.operators import plan_steps as PS
from slotwise.operators import quality as Q
from slotwise.operators import repeats as R
from slotwise.operators import timeline as TL
from slotwise.operators.joins import sized
from slotwise.operators.percentiles import exact_percentile_disc, exact_percentiles
from slotwise.schemas import SAMPLE_FIELDS
from slotwise.sources.jobs import creation_between


# --------------------------------------------------------------------- P1
def spill_or_bytes_offenders(jobs: DataFrame, s: S.SpillOrBytesSettings = S.SpillOrBytesSettings()) -> DataFrame:
    """Jobs with a sub-step in a stage that spilled too much, or that scanned too much.

    The condition is tested per stage with higher-order functions on the job
    row, so the three levels of unnest never materialize; jobs without any
    sub-step are not returned (the reference's inner unnests drop them).
    """
    start, end = s.window.bounds()
    j = TL.select_jobs(jobs, start, end)
    over_bytes = F.col("total_bytes_processed") > F.lit(s.maximum_bytes_billed)

    def stage_hits(st):
        has_substep = F.exists(st["steps"], lambda step: F.size(step["substeps"]) > 0)
        spilled = st["shuffle_output_bytes_spilled"] > F.lit(s.bytes_spilled_to_disk)
        return has_substep & (spilled | over_bytes)

    hit = j.filter(F.exists(F.col("job_stages"), stage_hits))
    out = hit.select("project_id", "user_email", "job_id", "query", "job_type")
    # One output row per job row already; the reference's DISTINCT only
    # collapses repeated job rows.  They are found by a hash of the row, so that
    # the query text of the others is not shuffled (``distinct_rows=False``
    # skips that, too).
    if not s.distinct_rows:
        return out
    print_ = F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in out.columns])
    marked = out.withColumn("_print", print_)
    again, rows = sized(marked.groupBy("_print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_print"))
    if not rows:
        return out
    once = marked.join(again, "_print", "left_anti").drop("_print")
    return once.unionByName(marked.join(again, "_print", "left_semi").drop("_print").distinct())


# --------------------------------------------------------------------- P2
def slot_sample_offenders(
    jobs: DataFrame, s: S.SlotSampleSettings = S.SlotSampleSettings(), method: str = "array"
) -> DataFrame:
    """Timeline samples of running jobs over the slot limits."""
    start, end = s.window.bounds()
    j = TL.select_jobs(jobs, start, end, s.check_state)
    prof = TL.timeline_profile(j, keep=("creation_time", "job_id", "query"), first="null", method=method)
    out = prof.filter(
        TL.over_limit(
            elapsed_gt=s.check_elapsed_ms,
            average_gt=s.check_average_slot_usage,
            total_slot_gt=s.check_total_slot_ms,
            average=F.col("average_slot_usage"),
        )
    ).select(
        "creation_time",
        "job_id",
        "elapsed_ms",
        "query",
        "prev_elapsed_ms",
        "total_slot_ms",
        "prev_total_slot_ms",
        "average_slot_usage",
        "unit_slot_usage",
        "pending_units",
        "completed_units",
        "active_units",
    )
    if s.echo_settings:
        out = out.withColumns(
            {
                "search_start_time": ts_lit(start),
                "search_finish_time": ts_lit(end),
                "search_maximum_bytes_processed": F.lit(s.search_maximum_bytes_processed).cast("long"),
                "search_maximum_waiting_ms": F.lit(s.search_maximum_waiting_ms).cast("long"),
                "check_elapsed_ms": F.lit(s.check_elapsed_ms).cast("long"),
                "check_average_slot_usage": F.lit(s.check_average_slot_usage).cast("long"),
                "check_total_slot_ms": F.lit(s.check_total_slot_ms).cast("long"),
                "check_bytes_spilled_to_disk": F.lit(s.check_bytes_spilled_to_disk).cast("long"),
                "check_state": F.array(*[F.lit(x) for x in s.check_state]),
            }
        )
    return out


# --------------------------------------------------------------------- P3
def slot_utilization_stats(
    jobs: DataFrame, s: S.UtilizationSettings = S.UtilizationSettings(), method: str = "array"
) -> DataFrame:
    """Per-bucket sums of P3 before scaling (``tb_stat2``)."""
    start, end = s.window.bounds()
    j = TL.select_jobs(jobs, start, end, s.check_state)
    prof = TL.timeline_profile(j, first="null", method=method)
    prof = TL.with_ctime(TL.with_prev_etime(prof, default="start", wait="zero"), mode=s.ctime)
    prof = B.with_bucket(prof, s.bucket_time)
    return prof.groupBy("ctime_bucket").agg(
        F.sum("target_waiting_ms").alias("sum_waiting_ms"),
        F.sum("average_slot_usage").alias("sum_average_slot_usage"),
        F.sum("unit_slot_usage").alias("sum_unit_slot_usage"),
        F.sum("pending_units").alias("sum_pending_units"),
        F.sum("completed_units").alias("sum_completed_units"),
        F.sum("active_units").alias("sum_active_units"),
    )


def slot_utilization(
    jobs: DataFrame,
    assignments: DataFrame,
    reservations: DataFrame,
    tables: DataFrame,
    s: S.UtilizationSettings = S.UtilizationSettings(),
    method: str = "array",
) -> DataFrame:
    """Slot use as a percentage of purchased capacity per time bucket."""
    stat = slot_utilization_stats(jobs, s, method)
    if s.project_id is None:
        project = C.default_project(tables)
    else:
        project = jobs.sparkSession.range(1).select(F.lit(s.project_id).alias("project_id"))
    cap = C.slot_capacity(assignments, reservations, project, s.capacity_job_type)
    return C.utilization(stat, cap, s.bucket_time)


# --------------------------------------------------------------------- P4
P4_JOB_COLUMNS = (
    "creation_time",
    "job_id",
    "job_type",
    "priority",
    "project_id",
    "query",
    "start_time",
    "state",
    "statement_type",
)
P4_SAMPLE_COLUMNS = (
    "elapsed_ms",
    "etime",
    "total_slot_ms",
    "average_slot_usage",
    "pending_units",
    "completed_units",
    "active_units",
)


def resource_hog_jobs(
    jobs: DataFrame, s: S.ResourceHogSettings = S.ResourceHogSettings(), method: str = "array"
) -> DataFrame:
    """Running jobs over the limits, with their last offending sample.

    The limits are applied before the 'last sample' step, so the sample shown
    is the last one over a limit.  Array form: filter the sorted timeline and
    take its last element, per row, without exploding or shuffling.
    """
    start, end = s.window.bounds()
    j = TL.select_jobs(jobs, start, end, s.check_state)
    limits = dict(
        elapsed_gt=s.threshold_elapsed_ms,
        average_gt=s.threshold_average_slot_usage,
        total_slot_gt=s.threshold_maximum_slot_ms,
    )
    waiting = ms_between(F.col("creation_time"), F.col("start_time")).alias("waiting_ms")
    if method == "window":
        prof = TL.timeline_profile(j, keep=P4_JOB_COLUMNS, first="null", method="window")
        prof = prof.filter(TL.over_limit(average=F.col("average_slot_usage"), **limits))
        return TL.last_sample_per_job(prof, [*P4_JOB_COLUMNS, "waiting_ms"], P4_SAMPLE_COLUMNS)
    offending = F.filter(TL.sorted_timeline(), lambda x: TL.over_limit(lambda n: x[n], **limits))

    def last_of_rows(rows: DataFrame) -> DataFrame:
        found = rows.select(*P4_JOB_COLUMNS, waiting, offending.alias("_off")).filter(F.size("_off") > 0)
        own = TL.last_element(F.col("_off"))
        sample = F.struct(*(own[f].alias(f) for f in SAMPLE_FIELDS), "start_time", "creation_time")
        return found.select(*P4_JOB_COLUMNS, "waiting_ms", sample.alias("_last"))

    once, again = TL.split_repeated(j)
    staged = last_of_rows(once)
    if again is not None:
        staged = staged.unionByName(TL.last_over_rows(last_of_rows(again), [*P4_JOB_COLUMNS, "waiting_ms"]))
    last = F.col("_last")
    return staged.select(
        *P4_JOB_COLUMNS,
        "waiting_ms",
        last["elapsed_ms"].alias("elapsed_ms"),
        F.timestamp_add(
            "MILLISECOND", F.coalesce(last["elapsed_ms"], F.lit(0).cast("long")), last["start_time"]
        ).alias("etime"),
        last["total_slot_ms"].alias("total_slot_ms"),
        TL.average_slot_usage(last["total_slot_ms"], last["elapsed_ms"]).alias("average_slot_usage"),
        last["pending_units"].alias("pending_units"),
        last["completed_units"].alias("completed_units"),
        last["active_units"].alias("active_units"),
    )


# --------------------------------------------------------------------- P5
def slot_threshold_calibration_input(
    jobs: DataFrame, s: S.CalibrationSettings = S.CalibrationSettings(), method: str = "array"
) -> DataFrame:
    """Per job, ``average_slot_usage`` of its last sample inside the elapsed band."""
    if len(s.check_state) != 1:
        raise ValueError("P5 percentiles are defined for exactly one state")
    start, end = s.window.bounds()
    job_elapsed = ms_between(F.col("start_time"), F.col("end_time"))
    j = TL.select_jobs(jobs, start, end, s.check_state, extra=job_elapsed > F.lit(s.threshold_elapsed_ms))
    lo, hi = s.threshold_elapsed_ms, s.threshold_elapsed_ms + s.band_ms
    if method == "window":
        prof = TL.timeline_profile(
            j,
            keep=("state",),
            first="null",
            method="window",
            sample_filter=lambda g: g("elapsed_ms").between(F.lit(lo), F.lit(hi)),
        )
        last = TL.last_sample_per_job(prof, ["job_id", "state"], ["average_slot_usage"])
        return last.select("state", "average_slot_usage")
    band = F.filter(TL.sorted_timeline(), lambda x: x["elapsed_ms"].between(F.lit(lo), F.lit(hi)))

    def last_of_rows(rows: DataFrame) -> DataFrame:
        own = TL.last_element(band)
        sample = F.struct(*(own[f].alias(f) for f in SAMPLE_FIELDS), "start_time", "creation_time")
        return rows.filter(F.size(band) > 0).select("job_id", "state", sample.alias("_last"))

    once, again = TL.split_repeated(j)
    rows = last_of_rows(once)
    if again is not None:
        rows = rows.unionByName(TL.last_over_rows(last_of_rows(again), ["job_id", "state"]))
    usage = TL.average_slot_usage(F.col("_last.total_slot_ms"), F.col("_last.elapsed_ms"))
    return rows.select("state", usage.alias("average_slot_usage"))


P5_COLUMNS = {
    1.0: "max_average_slot_usage",
    0.99: "p99_average_slot_usage",
    0.95: "p95_average_slot_usage",
}


def slot_threshold_calibration(
    jobs: DataFrame, s: S.CalibrationSettings = S.CalibrationSettings(), method: str = "array"
) -> DataFrame:
    """P5: max / p99 / p95 of per-job average slot usage, to choose P4's limits.

    One group holds every job, so the default ``method`` of the settings is an
    exact distributed selection (no task ever holds all values); ``"approx"``
    uses ``percentile_approx``; ``"builtin"`` the single-group aggregate.
    """
    values = slot_threshold_calibration_input(jobs, s, method)
    names = {p: P5_COLUMNS.get(p, f"p{int(round(p * 100))}_average_slot_usage") for p in s.percentiles}
    if s.method == "exact":
        return exact_percentile_disc(values, "average_slot_usage", names)
    if s.method == "approx":
        return values.agg(
            *[
                F.percentile_approx("average_slot_usage", float(p), s.approx_accuracy).cast("double").alias(n)
                for p, n in names.items()
            ]
        )
    if s.method == "builtin":
        return B.percentiles_by(values, [], "average_slot_usage", {n: p for p, n in names.items()}, "disc")
    raise ValueError(f"unknown percentile method {s.method!r}")


# --------------------------------------------------------------------- P6
def _elapsed_by_bytes_rows(jobs: DataFrame, s: S.ElapsedByBytesSettings) -> DataFrame:
    start, end = s.window.bounds()
    j = TL.select_jobs(jobs, start, end, s.check_state)
    total_ms = ms_between(F.col("start_time"), F.col("end_time"))
    if s.elapsed == "millisecond_field":
        elapsed = total_ms % F.lit(1000)
    elif s.elapsed == "total":
        elapsed = total_ms
    else:
        raise ValueError(f"elapsed must be 'millisecond_field' or 'total', got {s.elapsed!r}")
    return j.select(
        "total_bytes_processed",
        range_bucket(F.col("total_bytes_processed"), s.bytes_processed_bucket).alias("bucket_index"),
        elapsed.alias("elapsed_time"),
        "job_type",
        "statement_type",
    )


P6_PERCENTILES = {
    "p0_elapsed_time": 0.0,
    "p25_elapsed_time": 0.25,
    "p50_elapsed_time": 0.5,
    "p75_elapsed_time": 0.75,
    "p100_elapsed_time": 1.0,
}


def elapsed_by_bytes_bucket(jobs: DataFrame, s: S.ElapsedByBytesSettings = S.ElapsedByBytesSettings()) -> DataFrame:
    """Continuous percentiles of job elapsed time per bytes-processed bucket.

    The millisecond field has at most 1,000 distinct values, so a grouped aggregate's
    value -> count state stays tiny at any scale.  Total times (``elapsed="total"``) have no
    such bound: their two ranks next to each percentile are selected by ranges, and no task
    holds a group (see ``operators/percentiles.py``).
    """
    rows = _elapsed_by_bytes_rows(jobs, s)
    if s.elapsed == "total":
        asked = {name: ("elapsed_time", p) for name, p in P6_PERCENTILES.items()}
        stat = exact_percentiles(rows, asked, by=["bucket_index"], kind="cont")
    else:
        stat = B.percentiles_by(rows, ["bucket_index"], "elapsed_time", P6_PERCENTILES, kind="cont")
    return stat.select(
        bucket_label(F.col("bucket_index"), s.bytes_processed_bucket, s.overflow).alias("bucket_bytes_processed"),
        *P6_PERCENTILES,
    ).orderBy(F.asc_nulls_first("bucket_bytes_processed"))


def elapsed_by_bytes_raw(jobs: DataFrame, s: S.ElapsedByBytesSettings = S.ElapsedByBytesSettings()) -> DataFrame:
    """P6r: P6's rows before aggregation."""
    rows = _elapsed_by_bytes_rows(jobs, s)
    return rows.select(
        bucket_label(F.col("bucket_index"), s.bytes_processed_bucket, s.overflow).alias("bucket_bytes_processed"),
        "elapsed_time",
        "job_type",
        "statement_type",
    )


# --------------------------------------------------------------------- P7 / P8
def minute_usage(spark: SparkSession, jobs: DataFrame, s: S.MinuteUsageSettings = S.MinuteUsageSettings()) -> DataFrame:
    """Slot-ms and bytes per minute of the last ``minutes`` minutes, by 5 dimensions."""
    return G.usage_by_minute(
        spark, jobs, S.resolve_as_of(s.as_of), s.minutes, s.creation_lookback, G.MINUTE_DIMS, s.match
    )


def minute_usage_by_reservation(
    spark: SparkSession, jobs: DataFrame, s: S.MinuteUsageSettings = S.MinuteUsageSettings()
) -> DataFrame:
    """P7 with ``reservation_id`` as a sixth dimension."""
    dims = ("project_id", "job_type", "statement_type", "reservation_id", "priority", "state")
    return G.usage_by_minute(spark, jobs, S.resolve_as_of(s.as_of), s.minutes, s.creation_lookback, dims, s.match)


# --------------------------------------------------------------------- P9
P9_PERCENTILES = {
    "waiting_50": ("average_waiting_ms", 0.5),
    "elapsed_25": ("average_elapsed_ms", 0.25),
    "elapsed_50": ("average_elapsed_ms", 0.5),
    "elapsed_75": ("average_elapsed_ms", 0.75),
}


def slot_bucket_indicator(
    jobs: DataFrame, s: S.IndicatorSettings = S.IndicatorSettings(), method: str = "array"
) -> DataFrame:
    """Waiting / elapsed percentiles per job-size bucket.

    Percentiles are taken over the per-time-bucket averages.  No group is gathered:
    the values are written in ranges when the report is built, and ranks are
    selected from them (see ``operators/percentiles.py``).
    """
    start, end = s.window.bounds()
    j = TL.select_jobs(jobs, start, end, s.check_state).withColumnRenamed(
        "total_slot_ms", "finished_total_slot_ms"
    )
    # The size bucket depends on the job only: computed once per job row,
    # before the timeline is exploded.
    j = j.withColumn(
        "target_slot_ms_bucket", sign_floor_bucket(F.col("finished_total_slot_ms"), s.total_slot_ms_bucket)
    )
    prof = TL.timeline_profile(j, keep=("target_slot_ms_bucket",), first="zero", method=method)
    prof = TL.with_ctime(TL.with_prev_etime(prof, default="start", wait="null"))
    prof = B.with_bucket(prof, s.bucket_time)
    stat = B.bucket_averages(prof, ["ctime_bucket", "target_slot_ms_bucket"])
    per_size = exact_percentiles(stat, P9_PERCENTILES, by=["target_slot_ms_bucket"])
    return per_size.select(
        bucket_label(F.col("target_slot_ms_bucket"), s.total_slot_ms_bucket, s.overflow).alias(
            "total_slot_ms_bucket"
        ),
        *P9_PERCENTILES,
    ).orderBy(F.asc_nulls_first("total_slot_ms_bucket"))


# --------------------------------------------------------------------- P10
def monthly_slot_total(jobs: DataFrame, s: S.MonthlySettings = S.MonthlySettings()) -> DataFrame:
    """P10: slot totals of a period, as a 'monthly' total and daily/hourly/second averages."""
    start, end = s.bounds()
    j = jobs.filter(F.col("total_slot_ms").isNotNull()).filter(creation_between(jobs, start, end))
    total = F.sum("total_slot_ms")
    days = F.lit(s.days_per_month)
    return j.agg(
        (total / F.lit(1000)).alias("monthly_total_slot"),
        (total / F.lit(1000) / days).alias("average_daily_slot"),
        (total / F.lit(1000) / days / F.lit(24)).alias("average_hourly_slot"),
        (total / F.lit(1000) / days / F.lit(24) / F.lit(3600)).alias("average_sec_slot"),
    )


# --------------------------------------------------------------------- P11 / P12 / P14
def _plan_jobs(jobs: DataFrame, s: S.PredicateSettings, open_ended: bool = False) -> DataFrame:
    j = jobs
    if s.project_id is not None:
        j = j.filter(F.col("project_id") == F.lit(s.project_id))
    if open_ended:
        return j.filter(creation_between(j, s.start_date, None, include_start=False))
    return j.filter(creation_between(j, s.start_date, s.end_date))


def _predicate_levels(j: DataFrame, s: S.PredicateSettings, method: str, unique_jobs: bool, readers: bool) -> tuple[DataFrame, bool]:
    """Level rows of P11 / P12, and whether they still have to be made distinct."""

    def joined(rows: DataFrame) -> DataFrame:
        rs = PS.read_steps(PS.plan_substeps(rows, PS.JOB_KEYS))
        triples = PS.predicate_triples(rs, strict=not readers, trim=s.trim_columns)
        if not readers:
            return PS.usage_levels(triples)
        return PS.usage_levels(triples.filter(F.col("predicate_column").isNotNull()), PS.table_readers(rs))

    if method == "join":
        return joined(j), True
    if method != "row":
        raise ValueError(f"method must be 'row' or 'join', got {method!r}")
    if not readers:
        j = PS.with_keys(j)
    levels = PS.usage_levels_in_row(
        j, strict=not readers, trim=s.trim_columns, denominator="readers" if readers else "predicates", require_column=readers, unique_jobs=unique_jobs
    )
    return levels, False


def most_used_predicates(
    jobs: DataFrame, s: S.PredicateSettings = S.PredicateSettings(), method: str = "row", unique_jobs: bool = False
) -> DataFrame:
    """Columns filtered on per table; denominator = jobs with a predicate on the table.

    ``method="row"`` parses the plans inside their rows, in one scan, and matches
    predicates, columns and tables inside each job, whatever its rows;
    ``method="join"`` explodes and joins, as the reference does.  ``unique_jobs=True``
    saves the shuffle that brings a job's rows together, where the export is known
    to have one row per job and distinct stage names.
    """
    levels, distinct = _predicate_levels(_plan_jobs(jobs, s), s, method, unique_jobs, readers=False)
    return PS.predicate_ratio(levels, distinct=distinct)


def most_used_predicates_all_reads(
    jobs: DataFrame,
    s: S.PredicateSettings = S.PredicateSettings(),
    method: str = "row",
    table_storage: DataFrame | None = None,
    unique_jobs: bool = False,
) -> DataFrame:
    """As P11, but the denominator counts every job that reads the table.

    Equal to the reference's ``tables LEFT JOIN predicates LEFT JOIN columns``
    followed by ``predicate_column is not null``: every table row survives the
    left joins (denominator), and only fully matched rows have a column.
    ``table_storage`` (optional, disabled in the reference) adds the table's
    row, partition and byte counts with a left join on ``table_name``.
    """
    levels, distinct = _predicate_levels(_plan_jobs(jobs, s), s, method, unique_jobs, readers=True)
    return PS.predicate_ratio(levels, distinct=distinct, table_storage=table_storage)


def predicate_listing(
    jobs: DataFrame, s: S.PredicateSettings = S.PredicateSettings(), method: str = "row", unique_jobs: bool = False
) -> DataFrame:
    """Every (predicate, column, table) occurrence, un-aggregated.

    Jobs whose keys are on several rows take the join form; a count over the hashed
    keys, run when the report is built, finds them. ``unique_jobs=True`` skips it (see P11).
    """
    j = _plan_jobs(jobs, s, open_ended=True)

    def joined(rows: DataFrame) -> DataFrame:
        return PS.table_predicates(PS.read_steps(PS.plan_substeps(rows)), strict=True, trim=s.trim_columns).select(*PS.LISTING_COLUMNS)

    if method == "join":
        return joined(j)
    if method != "row":
        raise ValueError(f"method must be 'row' or 'join', got {method!r}")
    j = PS.with_keys(j)
    regular, others = (j, None) if unique_jobs else PS.split_regular(j)
    rows = PS.table_predicates_in_row(regular, strict=True, trim=s.trim_columns)
    return rows if others is None else rows.unionByName(joined(others))


# --------------------------------------------------------------------- P13
_SHAPE_COLUMNS = ["hash_id", "used_count", "total_slot_sum", "total_bytes_sum", "query"]


def most_used_queries(jobs: DataFrame, method: str = "aggregate") -> DataFrame:
    """Repeated query shapes with the heaviest sample text (NULL hash dropped).

    ``method="aggregate"``: grouped numbers, then the texts of the heaviest jobs;
    ``method="window"``: the reference's ``row_number() = 1`` sample joined
    back to the per-hash sums.
    """
    usage = R.usage_per_hash(jobs)
    if method == "window":
        out = usage.join(R.top_query_per_hash(jobs), "hash_id", "inner")
    elif method == "aggregate":
        out = R.with_heaviest_query(usage.filter(F.col("hash_id").isNotNull()), jobs)
    else:
        raise ValueError(f"method must be 'aggregate' or 'window', got {method!r}")
    return out.select(*_SHAPE_COLUMNS).orderBy(F.desc("used_count"))


def most_used_queries_concise(jobs: DataFrame) -> DataFrame:
    """The one-aggregation variant; keeps the NULL hash as a group."""
    out = R.with_heaviest_query(R.usage_per_hash(jobs), jobs)
    return out.select(*_SHAPE_COLUMNS).orderBy(F.desc("used_count"))


def most_used_queries_spilled(jobs: DataFrame, method: str = "aggregate") -> DataFrame:
    """P13s: P13c plus bytes spilled; hashes without any stage drop out.

    ``method="aggregate"`` sums each job's spill inside the row and folds it
    into the one per-hash aggregation; ``method="explode"`` is the reference
    form (unnest the stages, sum per hash, join to the per-hash usage).
    """
    if method == "explode":
        out = R.with_heaviest_query(R.usage_per_hash(jobs), jobs).join(R.spill_per_hash(jobs), "hash_id", "inner")
    elif method == "aggregate":
        usage = R.usage_per_hash(jobs, with_spill=True).filter(F.col("hash_id").isNotNull() & F.col("has_stage"))
        out = R.with_heaviest_query(usage, jobs)
    else:
        raise ValueError(f"method must be 'aggregate' or 'explode', got {method!r}")
    return out.select(*_SHAPE_COLUMNS, "sum_of_spilled").orderBy(F.desc("used_count"))


# --------------------------------------------------------------------- P15
def _series_samples(jobs: DataFrame, s: S.BucketSeriesSettings, method: str) -> DataFrame:
    prof = TL.timeline_profile(jobs, first="zero", method=method)
    prof = TL.with_ctime(TL.with_prev_etime(prof, default="start", wait="null"))
    return B.with_bucket(prof, s.bucket_time)


def _filled_series(spark: SparkSession, stat: DataFrame, s: S.BucketSeriesSettings) -> DataFrame:
    out = B.gap_fill(B.bucket_series(spark, *s.window.bounds(), s.bucket_time), stat)
    return out.select(
        "ctime_bucket",
        "job_count_per_timebucket",
        *[name for name, _ in B.BUCKET_AVERAGES],
    ).orderBy(F.asc_nulls_first("ctime_bucket"))


def bucket_series(
    spark: SparkSession, jobs: DataFrame, s: S.BucketSeriesSettings = S.BucketSeriesSettings(), method: str = "array"
) -> DataFrame:
    """Gap-free series of per-bucket usage averages."""
    start, end = s.window.bounds()
    j = TL.select_jobs(jobs, start, end, s.check_state)
    return _filled_series(spark, B.bucket_averages(_series_samples(j, s, method), ["ctime_bucket"]), s)


def write_bucket_days(
    jobs: DataFrame, path: str, days: Sequence[date], s: S.BucketSeriesSettings = S.BucketSeriesSettings(), method: str = "array"
) -> None:
    """Write P15's states of the jobs created on ``days``, in place of what is there for those days.

    Only those days' jobs are read.  Writing a day again, for instance when some of its jobs came
    late, replaces its state (see ``operators/daily.py``).
    """
    days = sorted(set(days))
    if not days:
        return
    first = datetime.combine(days[0], time(), timezone.utc)
    last = datetime.combine(days[-1], time(), timezone.utc) + timedelta(days=1, microseconds=-1)
    j = TL.select_jobs(jobs, first, last, s.check_state).filter(D.creation_day().isin(days))
    D.write_days(D.bucket_states(_series_samples(j, s, method)), path, days)


def bucket_series_from_days(spark: SparkSession, path: str, s: S.BucketSeriesSettings = S.BucketSeriesSettings()) -> DataFrame:
    """P15 from the states that :func:`write_bucket_days` wrote, without reading the history.

    States are kept by whole days, so the jobs are those created from the window's first day up to its end, which
    both have to be midnights (UTC); a day of the window that was never written is an error.
    """
    start, end = s.window.bounds()
    midnight = time()
    if start.time() != midnight or end.time() != midnight:
        raise ValueError(f"the window must begin and end at midnight, got {start} to {end}")
    states = D.read_days(spark, path, start.date(), end.date() - timedelta(days=1))
    return _filled_series(spark, D.merged_averages(states), s)


# --------------------------------------------------------------------- P16-P18
def duplicate_job_ids(jobs: DataFrame) -> DataFrame:
    """``job_id`` values on more than one row."""
    return Q.duplicate_job_ids(jobs)


def missing_slot_jobs(jobs: DataFrame, columns=None) -> DataFrame:
    """Jobs whose NULL ``total_slot_ms`` has no known cause."""
    return Q.missing_slot_jobs(jobs, columns)


def job_timeline(jobs: DataFrame, job_id: str | None = None) -> DataFrame:
    """Timeline samples of one job (or of every job, with ``job_id``)."""
    return Q.job_timeline(jobs, job_id)


__all__ = [
    "spill_or_bytes_offenders",
    "slot_sample_offenders",
    "slot_utilization",
    "slot_utilization_stats",
    "resource_hog_jobs",
    "slot_threshold_calibration",
    "slot_threshold_calibration_input",
    "elapsed_by_bytes_bucket",
    "elapsed_by_bytes_raw",
    "minute_usage",
    "minute_usage_by_reservation",
    "slot_bucket_indicator",
    "monthly_slot_total",
    "most_used_predicates",
    "most_used_predicates_all_reads",
    "most_used_queries",
    "most_used_queries_concise",
    "most_used_queries_spilled",
    "predicate_listing",
    "bucket_series",
    "bucket_series_from_days",
    "write_bucket_days",
    "duplicate_job_ids",
    "missing_slot_jobs",
    "job_timeline",
    "SAMPLE_FIELDS",
]
