"""Readers round-trip Parquet with the explicit schemas."""

from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.plans import reports as P
from slotwise.plans.registry import SETTINGS
from slotwise.sources import jobs as src


def test_readers_round_trip(spark, fixture_jobs, tmp_path):
    d = str(tmp_path)
    fixture_jobs.jobs.write.parquet(f"{d}/jobs")
    cat = fixture_jobs.catalog
    cat.tables.write.parquet(f"{d}/tables")
    cat.assignments.write.parquet(f"{d}/assignments")
    cat.reservations.write.parquet(f"{d}/reservations")
    spark.createDataFrame([("p", "ds", "t", 1, 1, 1, 1)], schemas.TABLE_STORAGE).write.parquet(f"{d}/storage")

    jobs = src.read_jobs(spark, f"{d}/jobs")
    assert jobs.schema == schemas.JOBS
    assert jobs.count() == fixture_jobs.jobs.count()
    one = src.read_jobs(spark, f"{d}/jobs", project_id="proj-1")
    assert one.count() == fixture_jobs.jobs.filter(F.col("project_id") == "proj-1").count() > 0

    tables = src.read_tables(spark, f"{d}/tables")
    assignments = src.read_assignments(spark, f"{d}/assignments")
    reservations = src.read_reservations(spark, f"{d}/reservations")
    assert src.read_table_storage(spark, f"{d}/storage").schema == schemas.TABLE_STORAGE
    assert reservations.schema == schemas.RESERVATIONS

    from_files = P.slot_utilization(jobs, assignments, reservations, tables, SETTINGS["slot_utilization"])
    in_memory = P.slot_utilization(
        fixture_jobs.jobs, cat.assignments, cat.reservations, cat.tables, SETTINGS["slot_utilization"]
    )
    assert from_files.collect() == in_memory.collect()
