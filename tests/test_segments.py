"""Lags and last samples of ids on several rows: segments against windows, and how they are spread."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from slotwise.operators import timeline as TL
from slotwise.operators.percentiles import exact_percentiles

SCHEMA = (
    "job_id string, creation_time timestamp, start_time timestamp, timeline array<struct<elapsed_ms:long,total_slot_ms:long,"
    "pending_units:long,completed_units:long,active_units:long>>"
)
T0 = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def _many_ranges(spark):
    """Small ranges stay apart, so that lags and ranks do cross them."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def history(seed: int, rows: int, ids: int):
    """Rows of few ids: equal ones, unlike ones, without id, with NULL samples, fields and times."""
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        n = rng.randrange(ids)
        start = None if rng.random() < 0.1 else T0 + timedelta(seconds=rng.randrange(3))
        tl = None if rng.random() < 0.1 else [
            (rng.choice([None, *range(0, 60, 5)]), rng.choice([None, rng.randrange(9)]), *(rng.randrange(2) for _ in range(3))) for _ in range(rng.randrange(5))
        ]
        out.append((None if n == 0 else f"j{n}", T0 + timedelta(seconds=n), start, tl))
    return out + [out[i] for i in range(0, rows, 3)] * 2 + [("alone", T0, T0, [(1, 1, 1, 1, 1), (2, 5, 1, 1, 1)])]


def bag(df):
    return Counter(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("filtered", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_every_method_gives_the_same_lags(spark, seed, filtered):
    jobs = spark.createDataFrame(history(seed, 40, 5), SCHEMA)
    keep = (lambda g: g("elapsed_ms").between(F.lit(5), F.lit(40))) if filtered else None
    want = bag(TL.timeline_profile(jobs, method="window", sample_filter=keep))
    for method in ("array", "segments"):
        assert bag(TL.timeline_profile(jobs, method=method, sample_filter=keep)) == want


def test_an_id_on_very_many_rows_is_spread(spark):
    """Two thirds of the rows are equal and of one id; no task holds them all, and lags run on across ranges."""
    rows = [("hot", i % 50 if i % 3 == 0 else 7, i) for i in range(6000)] + [(f"k{i}", i, i) for i in range(200)] + [(None, i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, o long, x long")
    lagged = TL.segmented_lag(df.drop("x"), "k", ["o"], {"before": F.col("o")})
    want = df.withColumn("before", F.lag("o").over(Window.partitionBy("k").orderBy("o"))).drop("x")
    assert bag(lagged) == bag(want)
    sizes = df.repartitionByRange("k", "o", F.monotonically_increasing_id()).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 3000


def test_last_samples_over_rows(spark):
    jobs = spark.createDataFrame(history(3, 60, 6), SCHEMA).filter("timeline is not null and size(timeline) > 0")
    fields = list(TL.SAMPLE_FIELDS)
    prof = jobs.select("job_id", "creation_time", "start_time", F.inline("timeline"))
    want = bag(TL.last_sample_per_job(prof, ["job_id", "creation_time"], fields))
    own = TL.last_element(TL.sorted_timeline())
    sample = F.struct(*(own[f].alias(f) for f in fields), "start_time", "creation_time").alias("_last")
    found = TL.last_over_rows(jobs.select("job_id", "creation_time", sample), ["job_id", "creation_time"])
    assert bag(found.select("job_id", "creation_time", *(F.col("_last")[f].alias(f) for f in fields))) == want


@pytest.mark.parametrize("kind", ["disc", "cont"])
def test_percentiles_by_ranges_equal_the_aggregates(spark, kind):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, rng.gauss(0, 9), 7.0, 7.0]), rng.choice([1e300, -1e-300, float(rng.randrange(50))])) for _ in range(3000)]
    rows += [("empty", None, None), ("one", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    targets = {f"{c}{int(p * 1000)}": (c, p) for c in "xy" for p in (0.0, 0.1, 0.333, 0.5, 0.95, 1.0)}
    want = df.groupBy("g").agg(*(F.expr(f"percentile_{kind}({p}) WITHIN GROUP (ORDER BY {c})").alias(n) for n, (c, p) in targets.items()))
    want = {r["g"]: r.asDict() for r in want.collect()}
    for fanout in (None, 1, 37):
        found = {r["g"]: r.asDict() for r in exact_percentiles(df, targets, by=["g"], fanout=fanout, kind=kind).collect()}
        assert found.keys() == want.keys()
        for g, row in want.items():
            assert all((found[g][n] is None) == (v is None) and (v is None or found[g][n] == pytest.approx(v, rel=1e-12)) for n, v in row.items() if n != "g")
    assert exact_percentiles(df.limit(0), targets, kind=kind).first()["x500"] is None


def test_many_groups_take_no_other_way(spark):
    df = spark.range(5000).select((F.col("id") % 1500).alias("g"), F.col("id").cast("double").alias("x"))
    found = exact_percentiles(df, {"top": ("x", 1.0)}, by=["g"])
    assert found.count() == 1500 and found.filter("top % 1500 <> g").count() == 0
