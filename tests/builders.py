"""Hand-made job rows for edge-case tests."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from slotwise.schemas import JOBS

T0 = datetime(2024, 2, 1, 12, 0, 0, tzinfo=timezone.utc)


def ts(seconds: float = 0.0) -> datetime:
    return T0 + timedelta(seconds=seconds)


def sample(elapsed, slot, pending=0, completed=0, active=0):
    return (elapsed, slot, pending, completed, active)


def stage(name, substeps, spilled=0, kind="READ", sid=1):
    return (name, sid, 100, spilled, 1, 1, 1, [(kind, substeps)])


def job(job_id="j1", **kw):
    row = {
        "project_id": "proj-0",
        "user_email": "u@example.com",
        "job_id": job_id,
        "job_type": "QUERY",
        "statement_type": "SELECT",
        "priority": "BATCH",
        "state": "DONE",
        "creation_time": ts(0),
        "start_time": ts(1),
        "end_time": ts(10),
        "query": f"SELECT {job_id}",
        "total_bytes_processed": 1000,
        "total_slot_ms": 5000,
        "reservation_id": None,
        "cache_hit": False,
        "error_result": None,
        "query_info": (("h1",),),
        "timeline": [],
        "job_stages": [],
    }
    row.update(kw)
    return tuple(row[f.name] for f in JOBS.fields)


def jobs_df(spark, rows):
    return spark.createDataFrame(rows, JOBS)
