"""Property tests on random hand-made jobs (hypothesis)."""

from datetime import timedelta

from hypothesis import HealthCheck, Phase, assume, given, settings
from hypothesis import strategies as st

from builders import T0, job, jobs_df
from oracle_compare import normalized_rows
from literal_forms import usage_by_minute_theta
from slotwise.operators import grid as G
from slotwise.operators import timeline as TL

SETTINGS = dict(
    max_examples=12,
    deadline=None,
    phases=[Phase.explicit, Phase.reuse, Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)


def same(a, b):
    cols = a.columns
    assert normalized_rows(cols, a.collect()) == normalized_rows(cols, b.select(*cols).collect())


job_times = st.tuples(
    st.integers(min_value=-600, max_value=600),  # start offset, seconds
    st.one_of(st.none(), st.integers(min_value=-200, max_value=900)),  # end - start, seconds (may be negative)
    st.integers(min_value=0, max_value=999),  # start milliseconds
    st.one_of(st.none(), st.integers(min_value=0, max_value=10**6)),  # slot ms
    st.sampled_from(["DONE", "RUNNING", "PENDING"]),
    st.booleans(),  # whether the job has started
)


@settings(**SETTINGS)
@given(st.lists(job_times, min_size=1, max_size=12))
def test_minute_equi_rewrite_equals_range_join(spark, specs):
    rows = []
    for i, (start_s, dur_s, ms, slot, state, started) in enumerate(specs):
        start = T0 + timedelta(seconds=start_s, milliseconds=ms)
        end = None if dur_s is None else start + timedelta(seconds=dur_s)
        if started and end is not None:
            # An end one minute (mod 60) before the start gives a minute count of 0;
            # the division then raises, as the reference's plain division does.
            gap = (end.replace(second=0, microsecond=0) - start.replace(second=0, microsecond=0)).total_seconds()
            assume(int(gap // 60) % 60 != 59)
        rows.append(
            job(f"j{i}", creation_time=start - timedelta(seconds=1), start_time=start if started else None, end_time=end,
                total_slot_ms=slot, state=state, priority="P" + str(i % 2))
        )
    jobs = jobs_df(spark, rows)
    kw = dict(as_of=T0 + timedelta(minutes=12), minutes=30, creation_lookback=timedelta(hours=1))
    same(G.usage_by_minute(spark, jobs, **kw), usage_by_minute_theta(spark, jobs, **kw))


timelines = st.lists(
    st.tuples(
        st.one_of(st.none(), st.integers(min_value=0, max_value=10**6)),
        st.one_of(st.none(), st.integers(min_value=0, max_value=10**9)),
    ),
    max_size=6,
    unique_by=lambda t: t[0],  # no ties in the window order
)


@settings(**SETTINGS)
@given(st.lists(timelines, min_size=1, max_size=5))
def test_array_lag_equals_window_lag(spark, tls):
    rows = [
        job(f"j{i}", timeline=[(e, s, 1, 2, 3) for e, s in tl])
        for i, tl in enumerate(tls)
    ]
    jobs = jobs_df(spark, rows)
    for first in ("null", "zero"):
        a = TL.with_ctime(TL.with_prev_etime(TL.timeline_profile(jobs, first=first, method="array")))
        b = TL.with_ctime(TL.with_prev_etime(TL.timeline_profile(jobs, first=first, method="window")))
        same(a, b)


SUBSTEPS = st.sampled_from(
    [
        "$1:a,$2:b",
        "$1:a, $2:c",
        "$2:b",
        "$3:d,$1:e",
        "FROM t1",
        "FROM t2",
        "FROM  t3",
        "WHERE f($1)",
        "WHERE g($2, $1)",
        "WHERE h($3, $3)",
        "TO out",
    ]
)
STEP = st.one_of(
    st.none(),
    st.tuples(st.sampled_from(["READ", "WRITE"]), st.lists(SUBSTEPS, max_size=4)),
)
STAGE = st.tuples(
    st.sampled_from(["S0: Input", "S1: Input", "S2: Output", "S3: Input"]),
    st.one_of(st.none(), st.lists(STEP, max_size=3)),
)


@settings(**SETTINGS)
@given(
    st.lists(st.lists(STAGE, max_size=5), min_size=1, max_size=5),
    st.lists(st.tuples(st.sampled_from(["j0", "j1", "j2", None]), st.sampled_from(["u", "v", None]), st.sampled_from(["p", None])), min_size=5, max_size=5),
)
def test_in_row_mining_equals_joins_on_random_plans(spark, plans, keys):
    """Repeated job ids, NULL keys and repeated stage names included."""
    from slotwise import settings as S
    from slotwise.plans import reports as P

    rows = [
        job(
            keys[i][0],
            user_email=keys[i][1],
            project_id=keys[i][2],
            job_stages=[(name, k, 1, 2, 3, 4, 5, steps) for k, (name, steps) in enumerate(plan)],
        )
        for i, plan in enumerate(plans)
    ]
    jobs = jobs_df(spark, rows)
    s = S.PredicateSettings(start_date=T0 - timedelta(days=1), end_date=T0 + timedelta(days=1))
    for fn in (P.most_used_predicates, P.most_used_predicates_all_reads, P.predicate_listing):
        same(fn(jobs, s, method="row"), fn(jobs, s, method="join"))


@settings(**SETTINGS)
@given(st.lists(timelines, min_size=1, max_size=5), st.lists(st.sampled_from(["DONE", "RUNNING"]), min_size=5, max_size=5))
def test_last_sample_reports_array_equals_window(spark, tls, states):
    from slotwise import settings as S
    from slotwise.plans import reports as P

    rows = [
        job(f"j{i}", state=states[i], end_time=T0 + timedelta(seconds=30),
            timeline=[(e, s, 1, 2, 3) for e, s in tl])
        for i, tl in enumerate(tls)
    ]
    jobs = jobs_df(spark, rows)
    win = S.Window(as_of=T0 + timedelta(days=1), lookback=timedelta(days=2))
    hog = S.ResourceHogSettings(window=win, threshold_maximum_slot_ms=10**6, threshold_elapsed_ms=1000,
                                threshold_average_slot_usage=100)
    same(P.resource_hog_jobs(jobs, hog, "array"), P.resource_hog_jobs(jobs, hog, "window"))
    cal = S.CalibrationSettings(window=win, threshold_elapsed_ms=1000, band_ms=500000)
    same(P.slot_threshold_calibration_input(jobs, cal, "array"), P.slot_threshold_calibration_input(jobs, cal, "window"))
