"""Job history derived from the TPC-H-style ``orders`` and ``lineitem`` tables.

The supplied test data has no job history, so a deterministic, integer-only
derivation turns every order into one job and every line item of that order
into one timeline sample and one plan stage (rules in ``FIXTURES.md`` §2).  The
DuckDB oracle derives the same rows flat and independently; this module builds
the nested rows the library reads in production.

The derivation groups line items by order: one shuffle of narrow rows keyed by order, and
each group is one order's line items (TPC-H bounds that at seven).  Real deployments
read the job-history export with :func:`slotwise.sources.jobs.read_jobs`.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise import schemas

# --- fixed values of the derivation (FIXTURES.md §2) -------------------------
AS_OF = datetime(2024, 3, 1, 0, 0, 0, tzinfo=timezone.utc)
BASE_EPOCH_MS = 1704067200000  # 2024-01-01 00:00:00 UTC
CREATION_SPAN_MS = 5184000000  # 60 days
CREATION_K_MUL = 7919993
CREATION_C_MUL = 104729
START_DELAY_C_MUL = 37
START_DELAY_MOD = 2000
BYTES_MULTIPLIERS = [1, 10, 100, 1000]
# Irregular rows, by order key: queued jobs (neither start nor end), jobs
# cancelled before their start (an end only), jobs without a user, and jobs
# whose row is there twice (only where asked for).
PENDING_MOD, PENDING_REST = 37, 5
CANCELLED_MOD, CANCELLED_REST = 37, 6
NO_USER_MOD, NO_USER_REST = 41, 3
TWICE_MOD, TWICE_REST = 97, 11
LONG_MOD, LONG_REST = 23, 9
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Catalog:
    tables: DataFrame
    assignments: DataFrame
    reservations: DataFrame


@dataclass(frozen=True)
class Fixture:
    jobs: DataFrame
    catalog: Catalog
    table_storage: DataFrame | None = None


def _cents(x: Column) -> Column:
    return F.round(x * F.lit(100)).cast("long")


def _div100(x: Column) -> Column:
    """Integer division by 100 (truncating), exact on longs."""
    return ((x - x % 100) / 100).cast("long")


def _sample(x: Column) -> Column:
    """The timeline sample of one line."""
    return F.struct(
        x["elapsed_ms"].alias("elapsed_ms"),
        x["total_slot_ms"].alias("total_slot_ms"),
        (x["u"] % 50).alias("pending_units"),
        (x["rn"] * 10).alias("completed_units"),
        (x["n"] * 3).alias("active_units"),
    )


def _stage(x: Column) -> Column:
    """The plan stage of one line."""
    rn = x["rn"]
    columns = F.concat(
        F.lit("$1:c"),
        (x["u"] % 6).cast("string"),
        F.when(rn % 5 == 0, F.lit(", ")).otherwise(F.lit(",")),
        F.lit("$2:d"),
        (x["p"] % 4).cast("string"),
    )
    from_ = F.concat(F.lit("FROM proj.ds.t"), (x["p"] % 20).cast("string"))
    where = F.when(x["n"] % 2 == 0, F.lit("WHERE and(greater($1, 10), equal($2, 3))")).otherwise(
        F.lit("WHERE greater($1, 10)")
    )
    read_substeps = F.when(x["n"] == 7, F.array(columns, from_)).otherwise(F.array(columns, from_, where))
    steps = F.array(
        F.struct(F.lit("READ").alias("kind"), read_substeps.alias("substeps")),
        F.struct(F.lit("WRITE").alias("kind"), F.array(F.lit("TO __stage_output")).alias("substeps")),
    )
    return F.struct(
        F.concat(
            F.lit("S"),
            (rn - 1).cast("string"),
            F.when(rn % 3 == 0, F.lit(": Output")).otherwise(F.lit(": Input")),
        ).alias("name"),
        rn.alias("id"),
        x["ext_cents"].alias("shuffle_output_bytes"),
        F.when(x["rf"] == "R", x["ext_cents"] * 10).otherwise(F.lit(0).cast("long")).alias(
            "shuffle_output_bytes_spilled"
        ),
        x["p"].alias("records_read"),
        x["u"].alias("records_written"),
        x["n"].alias("parallel_inputs"),
        steps.alias("steps"),
    )


def derive_jobs(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Nested job rows (schema :data:`slotwise.schemas.JOBS`)."""
    # The line items are dealt out by order once, in seven narrow columns: window, grouping
    # and join below keep that partitioning, and the nested samples and stages are built after
    # the join, so no shuffle or sort holds them.
    key = F.col("l_orderkey")
    unstarted = ((key % PENDING_MOD) == PENDING_REST) | ((key % CANCELLED_MOD) == CANCELLED_REST)
    narrow = lineitem.filter(~unstarted).select(
        key.alias("k"),
        F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("u"),
        F.col("l_linenumber").alias("n"),
        F.col("l_quantity").cast("long").alias("q"),
        _cents(F.col("l_extendedprice")).alias("ext_cents"),
        F.col("l_returnflag").alias("rf"),
    )
    k, p, q = F.col("k"), F.col("p"), F.col("q")
    # Line order within an order: (l_linenumber, l_partkey, l_suppkey), ties broken
    # by quantity, price in cents and return flag so the order is total even where
    # the three-column key repeats (it does once at sf0.001).
    line_order = Window.partitionBy("k").orderBy("n", "p", "u", "q", "ext_cents", "rf")
    running = line_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dur_mult = F.when(k % 10 == 0, F.lit(20)).otherwise(F.lit(1)).cast("long")
    slot_mult = F.when(k % 10 == 3, F.lit(100)).otherwise(F.lit(1)).cast("long")
    dur = (q * 97 + p % 500 + 1) * dur_mult
    slots = (p % 40 + 1) * slot_mult
    lines = narrow.repartition("k").select(
        "k",
        "p",
        "u",
        F.col("n").cast("long").alias("n"),
        "ext_cents",
        "rf",
        F.row_number().over(line_order).cast("long").alias("rn"),
        F.sum(dur).over(running).alias("elapsed_ms"),
        F.sum(dur * slots).over(running).alias("total_slot_ms"),
    )
    line = F.struct("rn", "p", "u", "n", "ext_cents", "rf", "elapsed_ms", "total_slot_ms")
    per_order = lines.groupBy("k").agg(F.sort_array(F.collect_list(line)).alias("lines"))

    o = orders.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.col("o_orderstatus"),
        F.col("o_totalprice"),
        F.col("o_orderpriority"),
    )
    j = o.join(per_order, "k", "left").withColumns(
        {
            "timeline": F.transform("lines", _sample).cast(T.ArrayType(schemas.TIMELINE_SAMPLE)),
            "job_stages": F.transform("lines", _stage).cast(T.ArrayType(schemas.PLAN_STAGE)),
        }
    )

    k, c = F.col("k"), F.col("c")
    is_query = (k % 20 != 0) & (k % 20 != 1)
    pending, cancelled = (k % PENDING_MOD) == PENDING_REST, (k % CANCELLED_MOD) == CANCELLED_REST
    state = (
        F.when(pending, F.lit("PENDING"))
        .when(cancelled, F.lit("DONE"))
        .when(F.col("o_orderstatus") == "P", F.lit("RUNNING"))
        .otherwise(F.lit("DONE"))
    )
    creation_ms = F.lit(BASE_EPOCH_MS) + (k * CREATION_K_MUL + c * CREATION_C_MUL) % CREATION_SPAN_MS
    start_ms = creation_ms + (c * START_DELAY_C_MUL) % START_DELAY_MOD
    has_samples = F.coalesce(F.size("timeline") > 0, F.lit(False))
    last = F.element_at(F.col("timeline"), -1)
    last_elapsed = F.when(has_samples, last["elapsed_ms"])
    cache_hit = F.when(k % 17 == 0, F.lit(True)).when(k % 17 == 1, F.lit(None)).otherwise(F.lit(False))
    bytes_mult = F.element_at(F.array(*[F.lit(m).cast("long") for m in BYTES_MULTIPLIERS]), (k % 4 + 1).cast("int"))

    return j.select(
        F.concat(F.lit("proj-"), (c % 5).cast("string")).alias("project_id"),
        F.when(k % NO_USER_MOD != NO_USER_REST, F.concat(F.lit("user"), (c % 200).cast("string"), F.lit("@example.com"))).alias(
            "user_email"
        ),
        F.concat(F.lit("job_"), k.cast("string")).alias("job_id"),
        F.when(k % 20 == 0, F.lit("LOAD"))
        .when(k % 20 == 1, F.lit("EXTRACT"))
        .otherwise(F.lit("QUERY"))
        .alias("job_type"),
        F.when(~is_query, F.lit(None).cast("string"))
        .when(k % 7 == 0, F.lit("CREATE_TABLE_AS_SELECT"))
        .when(k % 7 == 1, F.lit("INSERT"))
        .when(k % 31 == 0, F.lit("TRUNCATE_TABLE"))
        .otherwise(F.lit("SELECT"))
        .alias("statement_type"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("INTERACTIVE"))
        .otherwise(F.lit("BATCH"))
        .alias("priority"),
        state.alias("state"),
        F.timestamp_millis(creation_ms).alias("creation_time"),
        F.when(~pending & ~cancelled, F.timestamp_millis(start_ms)).alias("start_time"),
        F.when(state.isin("RUNNING", "PENDING"), F.lit(None).cast("timestamp"))
        .otherwise(F.timestamp_millis(start_ms + F.coalesce(last_elapsed, F.lit(0).cast("long"))))
        .alias("end_time"),
        F.concat(
            F.lit("SELECT * FROM t"), (k % 40).cast("string"), F.lit(" WHERE c = "), k.cast("string")
        ).alias("query"),
        F.when(k % 13 == 0, F.lit(None).cast("long"))
        .otherwise(_div100(_cents(F.col("o_totalprice")) * bytes_mult))
        .alias("total_bytes_processed"),
        F.when(cache_hit == F.lit(True), F.lit(None).cast("long"))
        .otherwise(F.when(has_samples, last["total_slot_ms"]))
        .alias("total_slot_ms"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("res-"), (k % 3).cast("string")))
        .alias("reservation_id"),
        cache_hit.alias("cache_hit"),
        F.when(k % 29 == 0, F.struct(F.lit("invalidQuery").alias("reason"))).alias("error_result"),
        F.struct(
            F.struct(
                F.when(is_query, F.concat(F.lit("h"), (k % 40).cast("string"))).alias("normalized_literals")
            ).alias("query_hashes")
        ).alias("query_info"),
        F.col("timeline"),
        F.col("job_stages"),
    )


def derive_catalog(region: DataFrame) -> Catalog:
    """Capacity catalog: one reservation and one QUERY assignment per region."""
    r = F.col("r_regionkey").cast("long")
    reservations = region.select(
        F.concat(F.lit("res-"), r.cast("string")).alias("reservation_name"),
        ((r + 1) * 100).alias("slot_capacity"),
    )
    assignments = region.select(
        F.concat(F.lit("res-"), r.cast("string")).alias("reservation_name"),
        F.concat(F.lit("proj-"), r.cast("string")).alias("assignee_id"),
        F.lit("QUERY").alias("job_type"),
    )
    tables = region.select(F.lit("proj-0").alias("table_catalog"))
    return Catalog(tables=tables, assignments=assignments, reservations=reservations)


def with_repeated_rows(jobs: DataFrame) -> DataFrame:
    """The jobs, some of them on two rows."""
    key = F.substring_index("job_id", "_", -1).cast("long")
    return jobs.withColumn("_times", F.when(key % TWICE_MOD == TWICE_REST, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).withColumn(
        "_times", F.explode("_times")
    ).drop("_times")


def with_long_jobs(jobs: DataFrame) -> DataFrame:
    """The jobs, some of them lasting up to 30 days longer."""
    key = F.substring_index("job_id", "_", -1).cast("long")
    later = F.timestamp_micros(F.unix_micros("end_time") + key * 7919 % (30 * 24 * 60) * 60_000_000)
    return jobs.withColumn("end_time", F.when(key % LONG_MOD == LONG_REST, later).otherwise(F.col("end_time")))


def derive_table_storage(nation: DataFrame) -> DataFrame:
    """Sizes of the tables that the plans read, one per nation (some without plans)."""
    n = F.col("n_nationkey").cast("long")
    return nation.select(
        F.lit("proj").alias("project_id"),
        F.lit("ds").alias("table_schema"),
        F.concat(F.lit("proj.ds.t"), n.cast("string")).alias("table_name"),
        ((n + 1) * 1000).alias("total_rows"),
        (n % 3).alias("total_partitions"),
        ((n + 1) * 4096).alias("total_logical_bytes"),
        ((n + 1) * 1024).alias("total_physical_bytes"),
    )


def load_fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    """Derived jobs and catalog for one scale-factor folder of the test data."""
    orders = spark.read.parquet(os.path.join(sf_dir, "orders.parquet"))
    lineitem = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    region = spark.read.parquet(os.path.join(sf_dir, "region.parquet"))
    storage = derive_table_storage(spark.read.parquet(os.path.join(sf_dir, "nation.parquet")))
    return Fixture(jobs=derive_jobs(orders, lineitem), catalog=derive_catalog(region), table_storage=storage)
