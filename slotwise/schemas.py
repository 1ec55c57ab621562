"""Explicit schemas of the job-history export and the capacity catalog.

Job history is one row per job with the time series (``timeline``) and the
query plan (``job_stages``) nested inside the row.  Reading with an explicit
schema avoids inference and fixes the struct field order the timeline
operators rely on (``elapsed_ms`` first, so a natural struct sort orders
samples by elapsed time).
"""

from __future__ import annotations

from pyspark.sql import types as T

TIMELINE_SAMPLE = T.StructType(
    [
        T.StructField("elapsed_ms", T.LongType()),
        T.StructField("total_slot_ms", T.LongType()),
        T.StructField("pending_units", T.LongType()),
        T.StructField("completed_units", T.LongType()),
        T.StructField("active_units", T.LongType()),
    ]
)

SAMPLE_FIELDS = [f.name for f in TIMELINE_SAMPLE.fields]

PLAN_STEP = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("substeps", T.ArrayType(T.StringType())),
    ]
)

PLAN_STAGE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("shuffle_output_bytes", T.LongType()),
        T.StructField("shuffle_output_bytes_spilled", T.LongType()),
        T.StructField("records_read", T.LongType()),
        T.StructField("records_written", T.LongType()),
        T.StructField("parallel_inputs", T.LongType()),
        T.StructField("steps", T.ArrayType(PLAN_STEP)),
    ]
)

QUERY_INFO = T.StructType(
    [
        T.StructField(
            "query_hashes",
            T.StructType([T.StructField("normalized_literals", T.StringType())]),
        )
    ]
)

ERROR_RESULT = T.StructType([T.StructField("reason", T.StringType())])

JOBS = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("user_email", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("job_type", T.StringType()),
        T.StructField("statement_type", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("creation_time", T.TimestampType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("query", T.StringType()),
        T.StructField("total_bytes_processed", T.LongType()),
        T.StructField("total_slot_ms", T.LongType()),
        T.StructField("reservation_id", T.StringType()),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("error_result", ERROR_RESULT),
        T.StructField("query_info", QUERY_INFO),
        T.StructField("timeline", T.ArrayType(TIMELINE_SAMPLE)),
        T.StructField("job_stages", T.ArrayType(PLAN_STAGE)),
    ]
)

# Scalar (non-nested) job columns, in schema order.
JOB_SCALAR_COLUMNS = [
    f.name
    for f in JOBS.fields
    if not isinstance(f.dataType, (T.ArrayType, T.StructType))
]

TABLES = T.StructType([T.StructField("table_catalog", T.StringType())])

ASSIGNMENTS = T.StructType(
    [
        T.StructField("reservation_name", T.StringType()),
        T.StructField("assignee_id", T.StringType()),
        T.StructField("job_type", T.StringType()),
    ]
)

RESERVATIONS = T.StructType(
    [
        T.StructField("reservation_name", T.StringType()),
        T.StructField("slot_capacity", T.LongType()),
    ]
)

TABLE_STORAGE = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("table_schema", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("total_partitions", T.LongType()),
        T.StructField("total_logical_bytes", T.LongType()),
        T.StructField("total_physical_bytes", T.LongType()),
    ]
)
