"""Timeline operators.

A job's whole timeline sits in its own row, so the per-job ``lag`` of the
reference can be computed inside the array (``method="array"``, the default):
sort the samples by ``elapsed_ms`` with ``sort_array`` and read the previous
element with ``get(arr, i - 1)``.  That needs no shuffle at all, where the
window form (``method="window"``) hash-partitions every sample by ``job_id``.

The two are equal where a ``job_id`` is on one row.  Exports may hold an id on
several rows; a narrow grouped count finds such ids when the report is built.  Their samples, and
only theirs, take a segmented lag: they are range-partitioned by
(``job_id``, ``elapsed_ms``), lagged inside each range, and the last sample of an id in
one range is carried to its first sample in the next.  So an id on very many
rows is spread over tasks, where a window over ``job_id`` would be one task.

Samples of one id with equal ``elapsed_ms`` are ordered by their other fields and
then by the times of their rows, in every form; rows without an id count as one id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.time import add_ms, ms_between, to_long_half_away
from slotwise.operators.joins import sized
from slotwise.operators.staging import staged
from slotwise.schemas import SAMPLE_FIELDS
from slotwise.sources.jobs import creation_between

# A sample predicate gets an accessor ``g(field_name) -> Column`` so the same
# rule works on array elements and on exploded rows.
SamplePredicate = Callable[[Callable[[str], Column]], Column]

LAG_FIELDS = ("elapsed_ms", "total_slot_ms")
#: Order of the samples of one job id, whatever its rows.
SAMPLE_ORDER = (*SAMPLE_FIELDS, "start_time", "creation_time")
#: The same order once samples have their lags: of equal samples the first has another sample before it.
LAGGED_ORDER = (*SAMPLE_ORDER, *(f"prev_{f}" for f in LAG_FIELDS))


def select_jobs(
    jobs: DataFrame,
    start: datetime,
    end: datetime,
    states: Sequence[str] | None = None,
    extra: Column | None = None,
) -> DataFrame:
    """Jobs created in ``[start, end]`` and in one of ``states``.

    The time condition reaches the Parquet scan as pushed filters, and a
    ``creation_date`` partition column, when present, is pruned as well.
    """
    cond = creation_between(jobs, start, end)
    if states:
        cond = cond & F.col("state").isin(list(states))
    if extra is not None:
        cond = cond & extra
    return jobs.filter(cond)


def sorted_timeline(col: str = "timeline") -> Column:
    """Samples ordered by ``elapsed_ms`` ascending, NULLs first (struct order)."""
    return F.sort_array(F.col(col), asc=True)


def last_element(arr: Column) -> Column:
    """Last element of an array; NULL for an empty or NULL array (no ANSI error)."""
    return F.get(arr, F.size(arr) - F.lit(1))


def average_slot_usage(total_slot_ms: Column, elapsed_ms: Column) -> Column:
    return F.try_divide(total_slot_ms, elapsed_ms)


def over_limit(
    g: Callable[[str], Column] | None = None,
    *,
    elapsed_gt: float,
    average_gt: float,
    total_slot_gt: float,
    average: Column | None = None,
) -> Column:
    """``(elapsed > e and average > a) or total_slot_ms > t``."""
    g = g or F.col
    avg = average if average is not None else average_slot_usage(g("total_slot_ms"), g("elapsed_ms"))
    return ((g("elapsed_ms") > F.lit(elapsed_gt)) & (avg > F.lit(average_gt))) | (
        g("total_slot_ms") > F.lit(total_slot_gt)
    )


def _profile_array(jobs: DataFrame, keep: Sequence[str], sample_filter: SamplePredicate | None) -> DataFrame:
    staged = jobs.select(*keep, sorted_timeline().alias("_tl"))
    if sample_filter is None:
        # posexplode + indexed get: plain codegen'd expressions, no lambda.
        out = staged.select(*keep, "_tl", F.posexplode("_tl").alias("_pos", "_x"))
        prev = F.get(F.col("_tl"), F.col("_pos") - F.lit(1))
        out = out.select(
            *keep,
            *[F.col("_x")[f].alias(f) for f in SAMPLE_FIELDS],
            *[prev[f].alias(f"prev_{f}") for f in LAG_FIELDS],
            (F.col("_pos") > 0).alias("_has_prev"),
            prev["elapsed_ms"].alias("_prev_sample_elapsed_ms"),
        )
    else:
        tl = F.col("_tl")
        lagged = F.transform(
            tl,
            lambda x, i: F.struct(
                *[x[f].alias(f) for f in SAMPLE_FIELDS],
                *[F.get(tl, i - 1)[f].alias(f"prev_{f}") for f in LAG_FIELDS],
            ),
        )
        lagged = F.filter(lagged, lambda x: sample_filter(lambda name: x[name]))
        staged = staged.select(*keep, lagged.alias("_s"))
        s = F.col("_s")
        fields = list(SAMPLE_FIELDS) + [f"prev_{f}" for f in LAG_FIELDS]
        final = F.transform(
            s,
            lambda x, i: F.struct(
                *[x[f].alias(f) for f in fields],
                (i > 0).alias("_has_prev"),
                F.get(s, i - 1)["elapsed_ms"].alias("_prev_sample_elapsed_ms"),
            ),
        )
        out = staged.select(*keep, F.inline(final))
    prev_etime = F.when(
        F.col("_has_prev"),
        add_ms(F.col("start_time"), F.coalesce(F.col("_prev_sample_elapsed_ms"), F.lit(0).cast("long"))),
    )
    return out.withColumn("prev_etime_raw", prev_etime).drop("_has_prev", "_prev_sample_elapsed_ms")


def _etime() -> Column:
    return add_ms(F.col("start_time"), F.coalesce(F.col("elapsed_ms"), F.lit(0).cast("long")))


def _profile_window(jobs: DataFrame, keep: Sequence[str], sample_filter: SamplePredicate | None) -> DataFrame:
    out = jobs.select(*keep, F.inline("timeline"))
    w = Window.partitionBy("job_id").orderBy(*SAMPLE_ORDER)
    for f in LAG_FIELDS:
        out = out.withColumn(f"prev_{f}", F.lag(f).over(w))
    if sample_filter is not None:
        out = out.filter(sample_filter(F.col))
    again = Window.partitionBy("job_id").orderBy(*LAGGED_ORDER)
    return out.withColumn("_etime", _etime()).withColumn("prev_etime_raw", F.lag("_etime").over(again)).drop("_etime")


def segmented_lag(rows: DataFrame, key: str, order: Sequence[str], lags: dict[str, Column]) -> DataFrame:
    """``rows`` with ``lag(column) over (partition by key order by order)`` for each ``name -> column``.

    Rows are range-partitioned by key and order; a lag inside a range is a window over (range,
    key), and the first row of a key in a range gets the last row of the key's range before it.
    Equal rows are told apart by a row number, so a key that holds very many of them is spread
    as well.  The ranges come from a sample, so they are written once; names that
    begin with ``_seg`` are the function's own.
    """
    place = [key, *order, "_seg_tie"]
    values = F.struct(*(value.alias(name) for name, value in lags.items()))
    ranged = rows.withColumn("_seg_values", values).withColumn("_seg_tie", F.monotonically_increasing_id())
    ranged = staged(ranged.repartitionByRange(*place).withColumn("_seg", F.spark_partition_id()), "segments")
    inside = Window.partitionBy("_seg", key).orderBy(*place[1:])
    lagged = ranged.withColumn("_seg_before", F.lag("_seg_values").over(inside))
    tails = ranged.groupBy("_seg", key).agg(F.max_by("_seg_values", F.struct(*place[1:])).alias("_seg_last"))
    carry = F.lag("_seg_last").over(Window.partitionBy(key).orderBy("_seg"))
    tails = tails.select(F.col("_seg").alias("_seg_of"), F.col(key).alias("_seg_key"), carry.alias("_seg_carry")).filter("_seg_carry is not null")
    # Only first rows of a range lack a row before them there.
    meets = (F.col("_seg") == F.col("_seg_of")) & F.col(key).eqNullSafe(F.col("_seg_key"))
    joined = lagged.join(tails, meets, "left")
    before = F.coalesce("_seg_before", "_seg_carry")
    return joined.select(*rows.columns, *(before[name].alias(name) for name in lags))


def _profile_segments(jobs: DataFrame, keep: Sequence[str], sample_filter: SamplePredicate | None) -> DataFrame:
    out = jobs.select(*keep, F.inline("timeline")).withColumn("_etime", _etime())
    lags = {f"prev_{f}": F.col(f) for f in LAG_FIELDS}
    if sample_filter is None:
        lags["prev_etime_raw"] = F.col("_etime")
    out = segmented_lag(out, "job_id", SAMPLE_ORDER, lags)
    if sample_filter is not None:
        out = segmented_lag(out.filter(sample_filter(F.col)), "job_id", LAGGED_ORDER, {"prev_etime_raw": F.col("_etime")})
    return out.drop("_etime")


def split_repeated(jobs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose ``job_id`` is on one row, and the others (None if there are none).

    One grouped count over the ids decides; it is a job of its own.  Rows without an id count as one id.
    """
    ids = jobs.groupBy("job_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    ids, rows = sized(ids.select(F.col("job_id").alias("_again")))
    if not rows:
        return jobs, None
    same = F.col("job_id").eqNullSafe(F.col("_again"))
    return jobs.join(ids, same, "left_anti"), jobs.join(ids, same, "left_semi")


def timeline_profile(
    jobs: DataFrame,
    keep: Sequence[str] = ("job_id", "creation_time", "start_time"),
    first: str = "null",
    method: str = "array",
    sample_filter: SamplePredicate | None = None,
) -> DataFrame:
    """One row per timeline sample with lags and usage ratios.

    Output: ``keep`` columns, the sample fields, ``prev_elapsed_ms``,
    ``prev_total_slot_ms``, ``waiting_ms``, ``etime``, ``average_slot_usage``,
    ``unit_slot_usage`` and ``prev_etime_raw`` (the previous sample's
    ``etime``, NULL on the first sample).

    ``first="null"`` leaves the first sample's lags NULL (its unit usage is
    NULL); ``first="zero"`` replaces them by 0, so the first unit usage equals
    the average usage.  ``sample_filter`` drops samples after the first lags
    and before the ``etime`` lag (the order one reference script uses).
    """
    keep = list(dict.fromkeys(["job_id", "creation_time", "start_time", *keep]))
    if method == "array":
        once, again = split_repeated(jobs)
        out = _profile_array(once, keep, sample_filter)
        if again is not None:
            out = out.unionByName(_profile_segments(again, keep, sample_filter))
    elif method == "window":
        out = _profile_window(jobs, keep, sample_filter)
    elif method == "segments":
        out = _profile_segments(jobs, keep, sample_filter)
    else:
        raise ValueError(f"method must be 'array', 'window' or 'segments', got {method!r}")
    if first == "zero":
        for f in LAG_FIELDS:
            out = out.withColumn(f"prev_{f}", F.coalesce(F.col(f"prev_{f}"), F.lit(0).cast("long")))
    elif first != "null":
        raise ValueError(f"first must be 'null' or 'zero', got {first!r}")
    return out.withColumns(
        {
            "waiting_ms": ms_between(F.col("creation_time"), F.col("start_time")),
            "etime": add_ms(F.col("start_time"), F.coalesce(F.col("elapsed_ms"), F.lit(0).cast("long"))),
            "average_slot_usage": average_slot_usage(F.col("total_slot_ms"), F.col("elapsed_ms")),
            "unit_slot_usage": F.try_divide(
                F.col("total_slot_ms") - F.col("prev_total_slot_ms"),
                F.col("elapsed_ms") - F.col("prev_elapsed_ms"),
            ),
        }
    )


def with_prev_etime(df: DataFrame, default: str = "start", wait: str = "zero") -> DataFrame:
    """``target_waiting_ms`` and ``prev_etime``.

    The first sample carries the job's waiting time; later samples carry 0
    (``wait="zero"``) or NULL (``wait="null"``).  ``default="start"`` replaces
    the first sample's missing ``prev_etime`` by ``start_time``;
    ``default="null"`` leaves it NULL.
    """
    later = F.lit(0).cast("long") if wait == "zero" else F.lit(None).cast("long")
    if wait not in ("zero", "null"):
        raise ValueError(f"wait must be 'zero' or 'null', got {wait!r}")
    raw = F.col("prev_etime_raw")
    target = F.when(raw.isNull(), F.col("waiting_ms")).otherwise(later)
    if default == "start":
        prev = F.coalesce(raw, F.col("start_time"))
    elif default == "null":
        prev = raw
    else:
        raise ValueError(f"default must be 'start' or 'null', got {default!r}")
    return df.withColumns({"target_waiting_ms": target, "prev_etime": prev}).drop("prev_etime_raw")


def with_ctime(df: DataFrame, mode: str = "reference") -> DataFrame:
    """C4: the time a sample is attributed to.

    ``reference``: ``etime + round(diff / 2)`` with ``diff = etime - prev_etime``
    in ms (half a step *after* the sample, as the reference computes it);
    ``midpoint``: ``etime - round(diff / 2)``.
    """
    half = to_long_half_away(ms_between(F.col("prev_etime"), F.col("etime")) / F.lit(2))
    if mode == "reference":
        ctime = add_ms(F.col("etime"), half)
    elif mode == "midpoint":
        ctime = add_ms(F.col("etime"), -half)
    else:
        raise ValueError(f"mode must be 'reference' or 'midpoint', got {mode!r}")
    return df.withColumn("ctime", ctime)


def last_sample_per_job(
    df: DataFrame,
    job_columns: Sequence[str],
    sample_columns: Sequence[str],
    order: Sequence[str] = SAMPLE_ORDER,
) -> DataFrame:
    """C9 (window form): per job, the sample columns of its last sample.

    ``last_value`` over the whole ``job_id`` partition ordered by ``order``,
    then ``distinct`` - the reference formulation, used by the window paths.
    The array paths take the last element of each row's samples instead, and
    :func:`last_over_rows` where an id is on several rows.
    """
    w = Window.partitionBy("job_id").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    cols = [F.col(c) for c in job_columns] + [F.last(c).over(w).alias(c) for c in sample_columns]
    return df.select(*cols).distinct()


def last_over_rows(lasts: DataFrame, job_columns: Sequence[str], sample: str = "_last") -> DataFrame:
    """C9 for ids on several rows: ``job_columns`` and ``sample`` (a struct in sample order), made the id's last one.

    ``lasts`` holds each row's own last sample.  The largest of an id is a grouped maximum;
    rows that are then equal are one row, as the window form's ``distinct`` makes them.
    """
    top = lasts.groupBy(F.col("job_id").alias("_top_id")).agg(F.max(sample).alias("_top"))
    rows = lasts.select(*dict.fromkeys(["job_id", *job_columns])).distinct()
    joined = rows.join(top, F.col("job_id").eqNullSafe(F.col("_top_id")))
    return joined.select(*job_columns, F.col("_top").alias(sample))
