"""Usage over spans of minutes: two changes a row and running sums, against the expansion of every row."""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import replace
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from builders import T0, job, jobs_df, ts
from slotwise import settings as S
from slotwise.operators import grid as G
from slotwise.plans import reports as P

SCHEMA = "g string, h int, x decimal(28,0), y decimal(28,0), _lo long, _hi long"


def expanded(rows, first, last):
    out = {}
    for g, h, x, y, lo, hi in rows:
        for m in range(max(lo, first), min(hi, last) + 1):
            held = out.setdefault((m, g, h), [None, None])
            for i, v in enumerate((x, y)):
                if v is not None:
                    held[i] = v + (held[i] or 0)
    return Counter((*key, *held) for key, held in out.items())


def spans(seed, n, top):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        lo = rng.randrange(-top // 4, top)
        length = rng.choice([0, 1, 5, 1440, 4000, top]) + rng.randrange(3) - 1  # -1: ends before it begins
        rows.append((rng.choice(["a", "a", "a", "b", None]), rng.choice([1, None]), rng.choice([None, Decimal(0), Decimal(7), Decimal(10**18)]), rng.choice([None, Decimal(3)]), lo, lo + length))
    return rows + rows[: n // 4]


@pytest.mark.parametrize("seed,first,last", [(1, 0, 9000), (2, 1439, 2881), (3, 1440, 1440), (4, -3000, 2879)])
def test_running_sums_equal_the_expansion(spark, seed, first, last):
    rows = spans(seed, 60, 9000)
    found = G.usage_over_spans(spark.createDataFrame(rows, SCHEMA), ["g", "h"], ["x", "y"], first, last)
    assert Counter(tuple(r) for r in found.select("_minute", "g", "h", "x", "y").collect()) == expanded(rows, first, last)


def test_no_rows_and_no_dimensions(spark):
    df = spark.createDataFrame([("a", 1, Decimal(5), Decimal(5), 10, 5000)], SCHEMA)
    assert G.usage_over_spans(df.limit(0), ["g"], ["x"], 0, 9000).count() == 0
    found = G.usage_over_spans(df, [], ["x"], 0, 9000)
    assert found.agg(F.min("_minute"), F.max("_minute"), F.count("*"), F.sum("x")).first() == (10, 5000, 4991, 5 * 4991)


def test_rows_before_the_group_by_do_not_grow_with_the_length(spark):
    """A hot group of jobs of 30 days: two changes a job, never one row per job and minute."""
    jobs = spark.range(2000).select(F.lit("a").alias("g"), F.lit(1).cast("decimal(28,0)").alias("x"), F.col("id").alias("_lo"), (F.col("id") + 43200).alias("_hi"))
    used = G.usage_over_spans(jobs, ["g"], ["x"], 0, 50000)
    assert used.agg(F.sum("x")).first()[0] == 2000 * 43201


def test_rows_are_read_and_shuffled_once(spark, sf_dir):
    """Blocks' totals and blocks share one exchange of merged changes."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.col("o_orderkey").cast("long")
    rows = orders.select((F.col("o_custkey") % 3).alias("g"), F.lit(1).cast("decimal(28,0)").alias("x"), at.alias("_lo"), (at + 5000).alias("_hi"))
    used = G.usage_over_spans(rows, ["g"], ["x"], 0, 9000)
    used.collect()
    plan = used._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1


def test_shares_add_up_whatever_the_job(spark):
    as_of = T0 + timedelta(days=2)
    rows = [
        job("none", start_time=None, end_time=None),
        job("open", start_time=ts(0), end_time=None, total_slot_ms=2881),
        job("null", start_time=ts(0), end_time=ts(600), total_slot_ms=None, total_bytes_processed=None),
        job("back", start_time=ts(600), end_time=ts(0), total_slot_ms=10**6),
        job("thirds", start_time=ts(0), end_time=ts(120), total_slot_ms=-100),
    ] * 2
    s = S.MinuteUsageSettings(as_of=as_of, minutes=3 * 1440, creation_lookback=timedelta(days=3), match="overlap")
    by_minute = {r["stb"]: r["total_slot_ms"] for r in P.minute_usage(spark, jobs_df(spark, rows), s).collect()}
    assert len(by_minute) == 3 * 1440
    t0 = T0.replace(tzinfo=None)
    assert by_minute[t0] == pytest.approx(2 * (1 - 33.333333), abs=1e-9)
    assert by_minute[t0 + timedelta(minutes=3)] == by_minute[t0 + timedelta(days=2)] == 2.0
    assert by_minute[t0 - timedelta(minutes=1)] is None
    same = {r["stb"]: r["total_slot_ms"] for r in P.minute_usage(spark, jobs_df(spark, rows[:5]), replace(s, minutes=60)).collect()}
    assert same == {t: v / 2 for t, v in by_minute.items() if t in same}
