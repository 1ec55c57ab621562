"""Which rows take the join form, and how they are told apart."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from builders import T0, job, jobs_df, stage
from oracle_compare import normalized_rows
from slotwise import schemas
from slotwise import settings as S
from slotwise.operators import joins
from slotwise.operators import plan_steps as PS
from slotwise.plans import reports as P

SETTING = S.PredicateSettings(start_date=T0 - timedelta(days=1), end_date=T0 + timedelta(days=1))
PLAN = [stage("S0: Input", ["$1:a,$2:b", "FROM t.one", "WHERE f($1, $2)"])]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same_rows(a, b):
    assert normalized_rows(a.columns, a.collect()) == normalized_rows(b.columns, b.collect())


def test_whole_rows_are_never_shuffled_to_split_them(spark):
    """More repeated jobs than a join side of ids may broadcast: still no exchange holds the plans."""
    n = joins.BROADCAST_ROWS + 1
    one = jobs_df(spark, [job("x", job_stages=PLAN)]).drop("job_id")
    ids = spark.range(n).select(F.concat(F.lit("j"), "id").alias("job_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("_row")).drop("_row")
    ids = ids.union(spark.createDataFrame([("single",)], "job_id string"))
    jobs = ids.crossJoin(F.broadcast(one)).select(*schemas.JOBS.fieldNames())
    df = P.predicate_listing(jobs, SETTING)
    plan = plan_of(df)
    assert len(re.findall(r"BroadcastHashJoin .*LeftAnti", plan)) == 1 and len(re.findall(r"BroadcastHashJoin .*LeftSemi", plan)) == 3
    assert not re.search(r"SortMergeJoin .*Left(Anti|Semi)", plan)
    # $1 and $2, each met by two columns and two tables of the two rows' two predicates
    assert df.filter("job_id = 'single'").count() == 2 and df.count() == 2 + 16 * n


def test_split_finds_the_repeated_keys(spark):
    """A job id under another user or project is another job."""
    rows = [job(f"j{k}", job_stages=PLAN) for k in range(300)] + [job(f"j{k}", job_stages=PLAN) for k in range(0, 300, 7)]
    rows += [job("j1", user_email="other", job_stages=PLAN), job("j2", project_id="other", job_stages=PLAN)]
    jobs = jobs_df(spark, rows)
    regular, others = PS.split_regular(PS.with_keys(jobs))
    again = sorted(2 * [f"j{k}" for k in range(0, 300, 7)])
    assert sorted(r["job_id"] for r in others.select("job_id").collect()) == again
    assert regular.count() == len(rows) - len(again)
    same_rows(P.predicate_listing(jobs, SETTING), P.predicate_listing(jobs, SETTING, method="join"))


@pytest.mark.parametrize("bits", [1, 64, 40_000])
def test_jobs_that_share_a_bit_with_a_repeated_one(spark, monkeypatch, bits):
    """They take the join form as well, which gives them the same rows."""
    monkeypatch.setattr(PS, "REPEAT_BITS", bits)
    jobs = jobs_df(spark, [job(f"j{k // 2 if k < 6 else k}", job_stages=PLAN) for k in range(40)] + [job(None, job_stages=PLAN)])
    regular, others = PS.split_regular(PS.with_keys(jobs))
    assert regular.count() + others.count() == 40 and (others.count() == 40) == (bits == 1)
    same_rows(P.predicate_listing(jobs, SETTING), P.predicate_listing(jobs, SETTING, method="join"))


def test_stages_of_one_name_match_in_their_row(spark):
    """No join and no shuffle for a job on one row, and its stages of one name share columns and tables."""
    plan = [
        stage("S1: Input", ["$1:a", "$2:b", "WHERE f($1)", "WHERE g($1, $2)", None]),
        stage("S1: Input", ["FROM t.one", "FROM t.two", "$1:c"], sid=2),
        ("S1: Input", 3, 1, 0, 1, 1, 1, None),
        stage("S2: Input", ["$1:d", "FROM t.three", "WHERE h($1)"], sid=4),
        stage("S2: Output", ["$1:d", "FROM t.four", "WHERE h($1)"], sid=5),
        stage("S2: Output", ["$1:d", "FROM t.four", "WHERE h($1)"], sid=6),
    ]
    jobs = jobs_df(spark, [job("a", job_stages=plan), job("b", job_stages=PLAN), job("c", job_stages=[]), job("d")])
    df = P.predicate_listing(jobs, SETTING)
    assert "Join" not in plan_of(df) and "Exchange" not in plan_of(df)
    assert df.filter("job_id = 'a'").count() == 11
    same_rows(df, P.predicate_listing(jobs, SETTING, method="join"))
