"""Rewritten forms equal the reference formulations on the derived job history."""

import random

import pytest
from pyspark.sql import functions as F

from literal_forms import usage_by_minute_theta
from oracle_compare import normalized_rows
from slotwise.functions.buckets import range_bucket, sign_floor_bucket
from slotwise.operators import grid as G
from slotwise.operators.buckets import percentiles_by
from slotwise.operators.percentiles import exact_percentile_disc, exact_percentiles, rank_for
from slotwise.plans import reports as P
from slotwise.plans.registry import SETTINGS


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    ra, rb = a.collect(), b.collect()
    assert len(ra) == len(rb)
    assert normalized_rows(a.columns, ra) == normalized_rows(b.columns, rb)


def test_array_lag_equals_window_lag_p2(fixture_jobs):
    j = fixture_jobs.jobs
    s = SETTINGS["slot_sample_offenders"]
    same(P.slot_sample_offenders(j, s, method="array"), P.slot_sample_offenders(j, s, method="window"))


def test_array_lag_equals_window_lag_p3(fixture_jobs):
    j, c = fixture_jobs.jobs, fixture_jobs.catalog
    s = SETTINGS["slot_utilization"]
    same(
        P.slot_utilization(j, c.assignments, c.reservations, c.tables, s, method="array"),
        P.slot_utilization(j, c.assignments, c.reservations, c.tables, s, method="window"),
    )


def test_array_equals_window_p4(fixture_jobs):
    s = SETTINGS["resource_hog_jobs"]
    same(P.resource_hog_jobs(fixture_jobs.jobs, s, "array"), P.resource_hog_jobs(fixture_jobs.jobs, s, "window"))


def test_array_equals_window_p5_input(fixture_jobs):
    s = SETTINGS["slot_threshold_calibration"]
    same(
        P.slot_threshold_calibration_input(fixture_jobs.jobs, s, "array"),
        P.slot_threshold_calibration_input(fixture_jobs.jobs, s, "window"),
    )


def test_array_equals_window_p9_p15(spark, fixture_jobs):
    j = fixture_jobs.jobs
    same(
        P.slot_bucket_indicator(j, SETTINGS["slot_bucket_indicator"], "array"),
        P.slot_bucket_indicator(j, SETTINGS["slot_bucket_indicator"], "window"),
    )
    same(
        P.bucket_series(spark, j, SETTINGS["bucket_series"], "array"),
        P.bucket_series(spark, j, SETTINGS["bucket_series"], "window"),
    )


@pytest.mark.parametrize(
    "fn", [P.most_used_predicates, P.most_used_predicates_all_reads, P.predicate_listing]
)
def test_in_row_mining_equals_joins(fixture_jobs, fn):
    s = SETTINGS["predicates"]
    same(fn(fixture_jobs.jobs, s, method="row"), fn(fixture_jobs.jobs, s, method="join"))


def test_minute_equi_join_equals_theta_join(spark, fixture_jobs):
    s = SETTINGS["minute_usage"]
    kw = dict(as_of=s.as_of, minutes=s.minutes, creation_lookback=s.creation_lookback)
    same(
        G.usage_by_minute(spark, fixture_jobs.jobs, **kw),
        usage_by_minute_theta(spark, fixture_jobs.jobs, **kw),
    )


def test_percentile_variants_agree(fixture_jobs):
    from dataclasses import replace

    base = SETTINGS["slot_threshold_calibration"]
    exact = P.slot_threshold_calibration(fixture_jobs.jobs, replace(base, method="exact"))
    builtin = P.slot_threshold_calibration(fixture_jobs.jobs, replace(base, method="builtin"))
    same(exact, builtin)
    # with an accuracy far above the number of values the sketch is exact too
    approx = P.slot_threshold_calibration(fixture_jobs.jobs, replace(base, method="approx"))
    same(exact, approx)


def test_exact_percentile_on_random_values(spark):
    rng = random.Random(7)
    for n in (1, 2, 3, 10, 257):
        vals = [float(rng.choice([rng.randint(0, 5), rng.random() * 1e6, -rng.random()])) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
        ps = {0.0: "p0", 0.25: "p25", 0.5: "p50", 0.95: "p95", 0.99: "p99", 1.0: "p100"}
        got = exact_percentile_disc(df, "x", ps, fanout=4).first().asDict()
        srt = sorted(vals)
        for p, name in ps.items():
            assert got[name] == srt[rank_for(p, n) - 1]
        ref = percentiles_by(df, [], "x", {v: k for k, v in ps.items()}, "disc").first().asDict()
        assert got == ref


def test_exact_percentile_heavy_duplicates(spark):
    rows = [(3.0,)] * 500 + [(1.0,)] * 10 + [(9.0,)] * 3
    df = spark.createDataFrame(rows, "x double")
    got = exact_percentile_disc(df, "x", {0.5: "m", 0.999: "hi", 0.0: "lo"}).first()  # ranks 257, 513, 1
    assert (got["m"], got["hi"], got["lo"]) == (3.0, 9.0, 1.0)


def test_exact_percentile_empty(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_percentile_disc(df, "x", {0.5: "m"}).first()["m"] is None


def test_range_bucket_equals_sign_floor_for_non_negative(spark):
    bounds = (10, 100, 1000)
    df = spark.createDataFrame([(v,) for v in (0, 9, 10, 11, 99, 100, 999, 1000, 5000)] + [(None,)], "x long")
    rows = df.select(
        range_bucket(F.col("x"), bounds).alias("a"), sign_floor_bucket(F.col("x"), bounds).alias("b")
    ).collect()
    assert all(r["a"] == r["b"] for r in rows)
    assert [r["a"] for r in rows] == [0, 0, 1, 1, 1, 2, 2, 3, 3, None]


def test_top_query_window_form_equals_aggregate(fixture_jobs):
    same(P.most_used_queries(fixture_jobs.jobs, "aggregate"), P.most_used_queries(fixture_jobs.jobs, "window"))


def test_table_sizes_join(spark, fixture_jobs):
    from slotwise.schemas import TABLE_STORAGE

    storage = spark.createDataFrame([("proj", "ds", "proj.ds.t1", 10, 1, 100, 50)], TABLE_STORAGE)
    out = P.most_used_predicates_all_reads(fixture_jobs.jobs, SETTINGS["predicates"], table_storage=storage)
    rows = out.filter("table_name = 'proj.ds.t1'").collect()
    assert rows and all(r["total_rows"] == 10 for r in rows)
    assert out.filter("table_name <> 'proj.ds.t1'").filter("total_rows is not null").count() == 0


def test_spilled_aggregate_equals_explode_form(fixture_jobs):
    same(
        P.most_used_queries_spilled(fixture_jobs.jobs, "aggregate"),
        P.most_used_queries_spilled(fixture_jobs.jobs, "explode"),
    )


def test_spill_offenders_without_distinct(fixture_jobs):
    from dataclasses import replace

    s = SETTINGS["spill_or_bytes_offenders"]
    same(P.spill_or_bytes_offenders(fixture_jobs.jobs, s), P.spill_or_bytes_offenders(fixture_jobs.jobs, replace(s, distinct_rows=False)))


def test_percentiles_of_extreme_values_need_no_cap(spark):
    values = [s * m * 10.0**e for s in (-1, 1) for m in (1, 1.0000000000000002, 3) for e in range(-300, 300, 7)]
    values += [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, float("inf"), float("-inf")]
    ordered = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ps = {p: f"p{i}" for i, p in enumerate((0.0, 0.01, 0.25, 0.5, 0.503, 0.75, 0.99, 1.0))}
    got = exact_percentile_disc(df, "x", ps).first()
    assert [got[n] for n in ps.values()] == [ordered[rank_for(p, len(values)) - 1] for p in ps]


def test_grouped_percentiles_equal_the_aggregate(spark):
    rows = [(None if k % 5 == 4 else k % 5, float((k * 7919) % 1000) / (1 + k % 3), None if k % 2 or k % 5 == 1 else k * 1e-9) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    targets = {"x25": ("x", 0.25), "x99": ("x", 0.99), "y50": ("y", 0.5)}
    want = df.groupBy("g").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})").alias(n) for n, (c, p) in targets.items()])
    got = exact_percentiles(df, targets, by=["g"], fanout=16)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    many = spark.range(600).selectExpr("id AS g", "cast(id AS double) AS x")
    assert exact_percentiles(many, {"m": ("x", 0.5)}, by=["g"]).filter("m = g").count() == 600
    assert exact_percentiles(many.limit(0), {"m": ("x", 0.5)}, by=["g"]).count() == 0
