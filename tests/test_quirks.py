"""Hand-made rows for the reference's edge rules."""

from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from builders import T0, job, jobs_df, sample, stage, ts
from slotwise import settings as S
from slotwise.operators import timeline as TL
from slotwise.plans import reports as P

WIN = S.Window(as_of=T0 + timedelta(days=1), lookback=timedelta(days=2))


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# --- timeline first-sample rules (Q14, Q15, Q25, Q29) ------------------------------
def test_first_sample_rules(spark):
    jobs = jobs_df(
        spark,
        [
            job(
                "a",
                start_time=ts(2),
                creation_time=ts(0),
                timeline=[sample(1001, 2002), sample(0, 0), sample(3003, 5005)],
            )
        ],
    )
    for method in ("array", "window"):
        prof = TL.timeline_profile(jobs, first="null", method=method)
        prof = TL.with_ctime(TL.with_prev_etime(prof, default="start", wait="zero"))
        got = sorted(rows_of(prof, "elapsed_ms", "prev_elapsed_ms", "unit_slot_usage", "target_waiting_ms", "ctime"))
        # order by elapsed: 0, 1001, 3003; average of 0 ms is NULL (safe divide)
        assert got[0][:4] == (0, None, None, 2000)
        assert got[1][:4] == (1001, 0, 2.0, 0)
        assert got[2][:4] == (3003, 1001, 1.5, 0)
        # odd gap of 1001 ms -> half is 500.5 -> rounds away from zero to 501
        assert got[1][4] == (ts(2) + timedelta(milliseconds=1001 + 501)).replace(tzinfo=None)
        prof0 = TL.with_prev_etime(TL.timeline_profile(jobs, first="zero", method=method), wait="null")
        z = sorted(rows_of(prof0, "elapsed_ms", "prev_elapsed_ms", "unit_slot_usage", "target_waiting_ms"))
        assert z[0] == (0, 0, None, 2000)
        assert z[1] == (1001, 0, 2.0, None)


def test_empty_and_null_timelines_drop_out(spark):
    jobs = jobs_df(spark, [job("a", timeline=[]), job("b", timeline=None), job("c", timeline=[sample(5, 10)])])
    for method in ("array", "window"):
        assert rows_of(TL.timeline_profile(jobs, method=method), "job_id") == [("c",)]


# --- P4: limits before the last sample (Q16) -------------------------------------
def test_resource_hog_shows_last_offending_sample(spark):
    tl = [sample(100, 50_000_000), sample(200, 150_000_000), sample(300, 150_000_001 - 1)]
    jobs = jobs_df(spark, [job("a", state="RUNNING", timeline=[tl[0], tl[1], (300, 10, 0, 0, 0)])])
    s = S.ResourceHogSettings(window=WIN)
    for method in ("array", "window"):
        got = rows_of(P.resource_hog_jobs(jobs, s, method), "job_id", "elapsed_ms", "total_slot_ms")
        assert got == [("a", 200, 150_000_000)]


# --- P5: band filter before the etime lag (Q17) ----------------------------------
def test_calibration_uses_last_sample_in_band(spark):
    jobs = jobs_df(
        spark,
        [
            job("a", end_time=ts(20), timeline=[sample(500, 5000), sample(1500, 3000), sample(3900, 39000), sample(4500, 1)]),
            job("b", end_time=ts(20), timeline=[sample(2000, 2000)]),
            job("c", end_time=ts(1.5), timeline=[sample(2000, 9999)]),  # job elapsed 500 ms: filtered
        ],
    )
    s = S.CalibrationSettings(window=WIN)
    for method in ("array", "window"):
        vals = sorted(r[0] for r in P.slot_threshold_calibration_input(jobs, s, method).select("average_slot_usage").collect())
        assert vals == [1.0, 10.0]
    out = P.slot_threshold_calibration(jobs, s).first()
    assert (out["max_average_slot_usage"], out["p95_average_slot_usage"]) == (10.0, 10.0)
    with pytest.raises(ValueError):
        P.slot_threshold_calibration(jobs, replace(s, check_state=("DONE", "RUNNING")))


# --- P6: millisecond field, NULL bucket, overflow (Q6, Q7) ----------------------
def test_elapsed_bytes_bucket_rules(spark):
    jobs = jobs_df(
        spark,
        [
            job("a", end_time=ts(1) + timedelta(seconds=5, milliseconds=123), total_bytes_processed=None),
            job("b", end_time=ts(1) + timedelta(milliseconds=900), total_bytes_processed=100000),
            job("c", end_time=ts(1) + timedelta(milliseconds=40), total_bytes_processed=99999),
        ],
    )
    s = S.ElapsedByBytesSettings(window=WIN)
    got = rows_of(P.elapsed_by_bytes_raw(jobs, s), "bucket_bytes_processed", "elapsed_time")
    assert sorted(got, key=str) == sorted([(None, 123), (500000, 900), (100000, 40)], key=str)
    over = jobs_df(spark, [job("d", total_bytes_processed=99999999999)])
    with pytest.raises(Exception):
        P.elapsed_by_bytes_bucket(over, s).collect()
    assert rows_of(P.elapsed_by_bytes_bucket(over, replace(s, overflow="null")), "bucket_bytes_processed") == [(None,)]


# --- P7: minute grid join rule and minute field (Q3, Q4) -------------------------
def test_minute_usage_rules(spark):
    as_of = T0 + timedelta(hours=2)
    jobs = jobs_df(
        spark,
        [
            job("in", start_time=ts(10), end_time=ts(50), total_slot_ms=600),  # inside 12:00
            job("cross", start_time=ts(50), end_time=ts(70), total_slot_ms=700),  # crosses 12:01: dropped
            job("edge", start_time=ts(60), end_time=ts(120), total_slot_ms=800),  # ends exactly on etb: dropped
            job("run", state="RUNNING", start_time=ts(130), end_time=None, total_slot_ms=7000, statement_type="INSERT"),
            job("long", state="RUNNING", start_time=ts(-3600), creation_time=ts(-3601), end_time=None,
                total_slot_ms=999, statement_type="MERGE"),
        ],
    )
    s = S.MinuteUsageSettings(as_of=as_of, minutes=200, creation_lookback=timedelta(hours=26))
    out = P.minute_usage(spark, jobs, s).filter(F.col("total_slot_ms").isNotNull())
    got = {(r["stb"], r["statement_type"]): r["total_slot_ms"] for r in out.collect()}
    # running job started 12:02, as_of 14:00: 118 minutes -> field 58 -> 59 buckets;
    # the one started at 11:00 ran 180 minutes -> field 0 -> 1 bucket
    assert got == {
        (T0.replace(tzinfo=None), "SELECT"): 600.0,
        ((T0 + timedelta(minutes=2)).replace(tzinfo=None), "INSERT"): 7000 / 59.0,
        ((T0 - timedelta(hours=1)).replace(tzinfo=None), "MERGE"): 999 / 1.0,
    }
    total = P.minute_usage(spark, jobs, s)
    assert total.select("stb").distinct().count() == 200


# --- plan parsing (Q8, Q9, Q22, Q23, X25) ---------------------------------------
PLAN = [
    stage("S0: Input", ["$1:a, $2:b", "FROM p.d.t1", "WHERE and($1, $2)"]),
    stage("S1: Output", ["$1:z", "FROM p.d.t9", "WHERE f($1)"]),
    stage("S2: Input", ["$1:c,$2:d", "FROM  spaced name", "WHERE f($2, $2)"]),
]


def test_predicate_parsing_rules(spark):
    jobs = jobs_df(spark, [job("a", job_stages=PLAN)])
    s = S.PredicateSettings(start_date=T0 - timedelta(days=1), end_date=T0 + timedelta(days=1))
    for method in ("row", "join"):
        lst = rows_of(P.predicate_listing(jobs, s, method), "stage_name", "table_name", "predicate_column")
        # " $2" (after ", ") never matches; the Output stage is skipped; $2 repeated twice
        assert sorted(lst) == sorted(
            [("S0: Input", "p.d.t1", "a"), ("S2: Input", " spaced name", "d"), ("S2: Input", " spaced name", "d")]
        )
        agg = rows_of(P.most_used_predicates(jobs, s, method), "table_name", "predicate_column", "table_used_cnt")
        assert sorted(agg) == [(" spaced name", "d", 1), ("p.d.t1", "a", 1)]
    trimmed = replace(s, trim_columns=True)
    got = rows_of(P.predicate_listing(jobs, trimmed), "table_name", "predicate_column")
    assert ("p.d.t1", "b") in got


def test_strict_column_split_raises(spark):
    jobs = jobs_df(spark, [job("a", job_stages=[stage("S0: Input", ["$1", "FROM t", "WHERE f($1)"])])])
    s = S.PredicateSettings(start_date=T0 - timedelta(days=1), end_date=T0 + timedelta(days=1))
    with pytest.raises(Exception):
        P.most_used_predicates(jobs, s).collect()
    # the safe variant (P12) gives a NULL column, which is then dropped
    assert P.most_used_predicates_all_reads(jobs, s).count() == 0


def test_spill_offenders_need_a_substep(spark):
    jobs = jobs_df(
        spark,
        [
            job("a", start_time=ts(1), total_bytes_processed=10**9, job_stages=[]),
            job("b", total_bytes_processed=10**9, job_stages=[stage("S0: Input", ["x"])]),
            job("c", total_bytes_processed=1, job_stages=[stage("S0: Input", ["x"], spilled=10**9)]),
            job("d", total_bytes_processed=1, job_stages=[stage("S0: Input", [], spilled=10**9)]),
        ],
    )
    s = S.SpillOrBytesSettings(window=WIN)
    assert sorted(rows_of(P.spill_or_bytes_offenders(jobs, s), "job_id")) == [("b",), ("c",)]


# --- repeats (Q18, Q19) -------------------------------------------------------
def test_repeat_reports(spark):
    jobs = jobs_df(
        spark,
        [
            job("a", total_slot_ms=5, query="qa", job_stages=[stage("S0: Input", [], spilled=7)]),
            job("b", total_slot_ms=9, query="qb", job_stages=[stage("S0: Input", [], spilled=None)]),
            job("c", total_slot_ms=9, query="qc"),
            job("n", total_slot_ms=1, query="qn", query_info=((None,),)),
            job("x", total_slot_ms=None, query="qx", query_info=(("h2",),)),
        ],
    )
    top = rows_of(P.most_used_queries(jobs), "hash_id", "used_count", "total_slot_sum", "query")
    assert sorted(top) == [("h1", 3, 23, "qb"), ("h2", 1, None, "qx")]
    concise = rows_of(P.most_used_queries_concise(jobs), "hash_id", "used_count")
    assert sorted(concise, key=str) == sorted([("h1", 3), ("h2", 1), (None, 1)], key=str)
    spilled = rows_of(P.most_used_queries_spilled(jobs), "hash_id", "sum_of_spilled")
    assert spilled == [("h1", 7)]


# --- gap fill (Q10) -----------------------------------------------------------
def test_bucket_series_counts_one_for_empty_buckets(spark):
    jobs = jobs_df(spark, [job("a", creation_time=ts(0), start_time=ts(0), timeline=[sample(1000, 100)])])
    s = S.BucketSeriesSettings(window=S.Window(as_of=T0 + timedelta(minutes=3), lookback=timedelta(minutes=3)))
    got = rows_of(P.bucket_series(spark, jobs, s), "ctime_bucket", "job_count_per_timebucket", "average_elapsed_ms")
    assert [g[1:] for g in got] == [(1, 1000.0), (1, None), (1, None), (1, None)]


# --- data checks (P16-P18) ------------------------------------------------------
def test_data_checks(spark):
    jobs = jobs_df(
        spark,
        [
            job("a", total_slot_ms=None),
            job("a", total_slot_ms=None, cache_hit=True),
            job("b", total_slot_ms=None, cache_hit=None),
            job("c", total_slot_ms=None, error_result=("boom",)),
            job("d", total_slot_ms=None, statement_type="CREATE_TABLE"),
            job("e", total_slot_ms=None, statement_type=None),
            job("f", timeline=[sample(1, 2, 3, 4, 5)]),
        ],
    )
    assert rows_of(P.duplicate_job_ids(jobs), "job_id") == [("a",)]
    assert sorted(rows_of(P.missing_slot_jobs(jobs), "job_id")) == [("a",), ("b",)]
    assert rows_of(P.job_timeline(jobs, "f"), "elapsed_ms", "active_units") == [(1, 5)]


def test_stage_without_steps_and_repeated_stage_names(spark):
    plan = [
        ("S0: Input", 1, 1, 0, 1, 1, 1, None),  # NULL steps
        stage("S1: Input", ["$1:a", "WHERE f($1)"]),
        stage("S1: Input", ["FROM t.one"], sid=2),  # same name: matched with the stage above
        stage("S2: Input", ["$1:b", "FROM t.two", "WHERE g($1)"]),
    ]
    jobs = jobs_df(spark, [job("a", job_stages=plan)])
    s = S.PredicateSettings(start_date=T0 - timedelta(days=1), end_date=T0 + timedelta(days=1))
    expected = sorted([("S1: Input", "t.one", "a"), ("S2: Input", "t.two", "b")])
    for method in ("row", "join"):
        got = rows_of(P.predicate_listing(jobs, s, method), "stage_name", "table_name", "predicate_column")
        assert sorted(got) == expected
        agg = rows_of(P.most_used_predicates(jobs, s, method), "table_name", "predicate_column")
        assert sorted(agg) == [("t.one", "a"), ("t.two", "b")]


# --- options beyond the reference -------------------------------------------------
def test_overlap_option_spreads_over_minutes(spark):
    as_of = T0 + timedelta(hours=1)
    jobs = jobs_df(spark, [job("x", start_time=ts(30), end_time=ts(150), total_slot_ms=900)])
    s = S.MinuteUsageSettings(as_of=as_of, minutes=70, match="overlap")
    got = sorted(
        (r["stb"], r["total_slot_ms"])
        for r in P.minute_usage(spark, jobs, s).filter(F.col("total_slot_ms").isNotNull()).collect()
    )
    # 12:00:30-12:02:30 touches the minutes 12:00, 12:01 and 12:02
    assert got == [((T0 + timedelta(minutes=m)).replace(tzinfo=None), 300.0) for m in range(3)]
    # the reference rule drops it (it crosses a minute boundary)
    assert P.minute_usage(spark, jobs, replace(s, match="reference")).filter(F.col("project_id").isNotNull()).count() == 0


def test_midpoint_ctime_and_total_elapsed_options(spark):
    jobs = jobs_df(spark, [job("a", start_time=ts(1), end_time=ts(1) + timedelta(seconds=5, milliseconds=123),
                               timeline=[sample(1000, 10), sample(3000, 30)])])
    prof = TL.with_prev_etime(TL.timeline_profile(jobs), default="start")
    mid = sorted(r["ctime"] for r in TL.with_ctime(prof, mode="midpoint").collect())
    assert mid == [(ts(1) + timedelta(milliseconds=500)).replace(tzinfo=None),
                   (ts(1) + timedelta(milliseconds=2000)).replace(tzinfo=None)]
    s = S.ElapsedByBytesSettings(window=WIN, elapsed="total")
    assert rows_of(P.elapsed_by_bytes_raw(jobs, s), "elapsed_time") == [(5123,)]
