"""Data checks on the job history (C27): uniqueness, unexplained NULLs, one timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.schemas import SAMPLE_FIELDS


def duplicate_job_ids(jobs: DataFrame) -> DataFrame:
    """``job_id`` values that occur on more than one row (expected: none)."""
    return (
        jobs.groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .select("job_id")
    )


def missing_slot_jobs(jobs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Jobs whose NULL ``total_slot_ms`` has no known cause.

    Known causes: an error, a cache hit, or a DDL statement other than
    ``CREATE ...``/``TRUNCATE ...``.  A NULL ``statement_type`` makes the
    ``not like`` tests NULL, so such rows are not returned (as in the
    reference).
    """
    st = F.col("statement_type")
    cond = (
        F.col("total_slot_ms").isNull()
        & F.col("error_result").isNull()
        & ~F.coalesce(F.col("cache_hit"), F.lit(False))
        & (~st.like("CREATE%") & ~st.like("TRUNCATE%"))
    )
    out = jobs.filter(cond)
    return out.select(*columns) if columns else out


def job_timeline(jobs: DataFrame, job_id: str | None = None, with_job_id: bool = False) -> DataFrame:
    """Timeline samples of one job (``job_id``) or, with ``None``, of every job."""
    src = jobs if job_id is None else jobs.filter(F.col("job_id") == F.lit(job_id))
    lead = ["job_id"] if with_job_id or job_id is None else []
    return src.select(*lead, F.inline("timeline")).select(*lead, *SAMPLE_FIELDS)
