"""Physical-plan checks: pushdown, no nested-loop joins, no avoidable shuffles."""

import re

import pytest

from slotwise.plans import reports as P
from slotwise.plans.registry import SETTINGS
from slotwise.sources.jobs import read_jobs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_jobs(spark, fixture_jobs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("jobs") / "jobs.parquet")
    fixture_jobs.jobs.write.parquet(path)
    return read_jobs(spark, path)


def test_time_filter_and_pruning_reach_the_scan(stored_jobs):
    plan = plan_of(P.monthly_slot_total(stored_jobs, SETTINGS["monthly_slot_total"]))
    assert re.search(r"PushedFilters: \[[^\]]*creation_time", plan)
    assert "ReadSchema: struct<creation_time:timestamp,total_slot_ms:bigint>" in plan


def test_minute_usage_has_no_nested_loop_join(spark, stored_jobs):
    for fn in (P.minute_usage, P.minute_usage_by_reservation):
        plan = plan_of(fn(spark, stored_jobs, SETTINGS["minute_usage"]))
        assert "NestedLoopJoin" not in plan
        assert "CartesianProduct" not in plan


def test_array_lag_needs_no_shuffle_before_bucket_aggregation(stored_jobs):
    df = P.slot_utilization_stats(stored_jobs, SETTINGS["slot_utilization"], method="array")
    plan = plan_of(df)
    # the only exchange is the bucket aggregation's
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "hashpartitioning(ctime_bucket" in plan
    assert "Window" not in plan
    window_plan = plan_of(P.slot_utilization_stats(stored_jobs, SETTINGS["slot_utilization"], method="window"))
    assert "hashpartitioning(job_id" in window_plan


def test_in_row_mining_has_no_join(stored_jobs):
    plan = plan_of(P.most_used_predicates(stored_jobs, SETTINGS["predicates"]))
    assert "Join" not in plan
    plan = plan_of(P.predicate_listing(stored_jobs, SETTINGS["predicates"]))
    assert "Join" not in plan and "Exchange" not in plan


def test_plan_mining_reads_the_history_once(stored_jobs):
    """P11 and P12 over repeated rows: one scan, no job when the report is built, one shuffle by job id."""
    from slotwise.sources.fixture import with_repeated_rows

    jobs = with_repeated_rows(stored_jobs)
    tracker = jobs.sparkSession.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    reports = [fn(jobs, SETTINGS["predicates"]) for fn in (P.most_used_predicates, P.most_used_predicates_all_reads)]
    assert len(tracker.getJobIdsForGroup(None)) == before
    for df in reports:
        plan = plan_of(df)
        assert plan.count("Scan parquet") == 1 and "Join" not in plan
        assert len(re.findall(r"hashpartitioning\(job_id", plan)) == 1


def test_repeat_reports_never_sort_texts(stored_jobs):
    for fn in (P.most_used_queries, P.most_used_queries_concise, P.most_used_queries_spilled):
        plan = plan_of(fn(stored_jobs))
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
        assert "BroadcastHashJoin" in plan


def test_percentile_reports_return_found_values(stored_jobs):
    for fn, key in ((P.slot_threshold_calibration, "slot_threshold_calibration"), (P.slot_bucket_indicator, "slot_bucket_indicator")):
        assert "percentile" not in plan_of(fn(stored_jobs, SETTINGS[key]))


def test_resource_hogs_need_no_shuffle(stored_jobs):
    plan = plan_of(P.resource_hog_jobs(stored_jobs, SETTINGS["resource_hog_jobs"]))
    assert "Exchange" not in plan


def test_date_partitions_are_pruned(spark, fixture_jobs, tmp_path_factory):
    from datetime import timedelta

    from pyspark.sql import functions as F

    from oracle_compare import normalized_rows
    from slotwise import settings as S
    from slotwise.sources.fixture import AS_OF

    path = str(tmp_path_factory.mktemp("parts") / "jobs")
    fixture_jobs.jobs.withColumn("creation_date", F.to_date("creation_time")).write.partitionBy(
        "creation_date"
    ).parquet(path)
    parted = read_jobs(spark, path, partitioned_by_date=True)
    flat = fixture_jobs.jobs
    s = S.MonthlySettings(as_of=AS_OF, search_pending_time=timedelta(days=20), target_period=timedelta(days=10))
    df = P.monthly_slot_total(parted, s)
    plan = plan_of(df)
    assert re.search(r"PartitionFilters: \[[^\]]*creation_date", plan)
    a, b = df.collect(), P.monthly_slot_total(flat, s).collect()
    assert normalized_rows(df.columns, a) == normalized_rows(df.columns, b)
    u = S.UtilizationSettings(window=S.Window(as_of=AS_OF, lookback=timedelta(days=5)))
    same_a = P.slot_utilization_stats(parted, u).collect()
    same_b = P.slot_utilization_stats(flat, u).collect()
    cols = P.slot_utilization_stats(flat, u).columns
    assert normalized_rows(cols, same_a) == normalized_rows(cols, same_b)


def test_derived_jobs_shuffle_narrow_line_items_once(spark):
    """Line items go by order once, before the nested samples and stages are built."""
    from slotwise.sources.fixture import derive_jobs

    orders = spark.createDataFrame(
        [(1, 10, "P", 5.5, "2-HIGH"), (2, 11, "F", 7.25, "5-LOW"), (2, 11, "F", 7.25, "5-LOW"), (3, 12, "O", 1.0, "1-URGENT"), (None, 1, "F", 1.0, "5-LOW")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string",
    )
    lines = [(1, 5, 6, 2, 3.0, 10.25, "R"), (1, 5, 6, 1, 2.0, 1.5, "N"), (2, 7, 8, 3, 1.0, 2.0, "A"), (None, 1, 1, 1, 1.0, 1.0, "N"), (1, None, 6, 3, 1.0, None, None)]
    items = spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    )
    jobs = derive_jobs(orders, items)
    shuffles = re.findall(r"Exchange hashpartitioning\((\w+)#", plan_of(jobs.select("timeline", "job_stages")))
    assert shuffles == ["k", "k"]  # orders and line items
    found = {r["job_id"]: r for r in jobs.collect()}
    assert jobs.count() == 5 and found["job_3"]["timeline"] is None and found[None]["job_stages"] is None
    one = found["job_1"]
    assert [tuple(x) for x in one["timeline"]] == [(200, 1200, 6, 10, 3), (497, 2982, 6, 20, 6), (497, 2982, 6, 30, 9)]
    assert [(s["name"], s["id"], s["shuffle_output_bytes_spilled"]) for s in one["job_stages"]] == [("S0: Input", 1, 0), ("S1: Input", 2, 10250), ("S2: Output", 3, 0)]
    assert one["job_stages"][1]["steps"][0]["substeps"] == ["$1:c0,$2:d1", "FROM proj.ds.t5", "WHERE and(greater($1, 10), equal($2, 3))"]
    assert one["job_stages"][2]["steps"][0]["substeps"] == [None, None, "WHERE greater($1, 10)"]
