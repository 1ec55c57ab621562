"""Repeated query shapes.

All three reports group jobs by the normalized query hash: one grouped
aggregation of fixed-width numbers, then the texts of the heaviest jobs alone.
A hash that covers a third of all jobs is reduced map-side before the shuffle
like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.operators.joins import sized

HASH_PATH = "query_info.query_hashes.normalized_literals"


def hash_col() -> Column:
    return F.col(HASH_PATH)


def usage_per_hash(jobs: DataFrame, with_spill: bool = False) -> DataFrame:
    """C25 (+ C26 folded in): per hash, job count, slot and byte sums, and the largest ``total_slot_ms``.

    Only counts and sums are grouped, so the partial aggregation is a hash table
    of fixed-width rows in every task.  ``with_spill`` adds ``sum_of_spilled`` (sum
    over every stage of every job) and ``has_stage`` (whether any job of the hash
    has at least one stage).  NULL hashes form their own group here.
    """
    aggs = [
        F.count(F.lit(1)).alias("used_count"),
        F.sum("total_slot_ms").alias("total_slot_sum"),
        F.sum("total_bytes_processed").alias("total_bytes_sum"),
        F.max("total_slot_ms").alias("top_slot_ms"),
    ]
    df = jobs.withColumn("hash_id", hash_col())
    if with_spill:
        stages = F.col("job_stages")
        spilled = F.filter(
            F.transform(stages, lambda s: s["shuffle_output_bytes_spilled"]), lambda v: v.isNotNull()
        )
        per_job = F.when(
            F.size(spilled) > 0,
            F.aggregate(spilled, F.lit(0).cast("long"), lambda acc, v: acc + v),
        )
        df = df.withColumns(
            {
                "_job_spilled": per_job,
                "_has_stage": F.coalesce(F.size(stages) > 0, F.lit(False)),
            }
        )
        aggs += [
            F.sum("_job_spilled").alias("sum_of_spilled"),
            F.max("_has_stage").alias("has_stage"),
        ]
    return df.groupBy("hash_id").agg(*aggs)


def with_heaviest_query(usage: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add ``query``, the text of each hash's heaviest job (C24): most ``total_slot_ms``, then the smallest ``job_id``.

    The heaviest jobs are found by their numbers; texts are read for those
    alone, through a join with the hashes (broadcast once counted to be few).
    """
    hashes, _ = sized(usage.select(F.col("hash_id").alias("_hash"), F.col("top_slot_ms").alias("_top")))
    slim = jobs.select(hash_col().alias("hash_id"), "total_slot_ms", "job_id", "query")
    heavy = slim.join(hashes, F.col("hash_id").eqNullSafe(F.col("_hash")) & F.col("total_slot_ms").eqNullSafe(F.col("_top")))
    first = Window.partitionBy("hash_id").orderBy(F.asc_nulls_first("job_id"), "query")
    texts = heavy.select("hash_id", "job_id", "query").withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    texts = texts.select(F.col("hash_id").alias("_hash"), "query")
    return usage.join(texts, F.col("hash_id").eqNullSafe(F.col("_hash"))).drop("_hash", "top_slot_ms")


def top_query_per_hash(jobs: DataFrame) -> DataFrame:
    """C24 (window form): the heaviest job's query per hash via ``row_number() = 1``.

    Catalyst plans this with a partial ``WindowGroupLimit`` before the
    shuffle.  The reports use :func:`with_heaviest_query` instead, which gives
    the same row.
    """
    w = Window.partitionBy("hash_id").orderBy(
        F.desc_nulls_last("total_slot_ms"), F.asc_nulls_first("job_id")
    )
    ranked = jobs.select("query", hash_col().alias("hash_id"), "total_slot_ms", "job_id").withColumn(
        "_rnk", F.row_number().over(w)
    )
    return ranked.filter(F.col("_rnk") == 1).select("query", "hash_id")


def spill_per_hash(jobs: DataFrame) -> DataFrame:
    """C26 (explode form): ``sum(shuffle_output_bytes_spilled)`` over stages, per hash.

    Jobs without stages drop out (inner unnest).
    """
    stages = jobs.select(hash_col().alias("hash_id"), F.explode("job_stages").alias("js"))
    return stages.groupBy("hash_id").agg(F.sum("js.shuffle_output_bytes_spilled").alias("sum_of_spilled"))
