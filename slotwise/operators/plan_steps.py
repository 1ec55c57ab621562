"""Query-plan mining (C10-C16): which columns are filtered on, per table.

Every job row carries its plan (stages -> steps -> sub-steps).  The READ
sub-steps of input stages come in three forms (column list, FROM, WHERE) that
the reference parses separately and joins back on
``(project_id, user_email, job_id, stage_name, kind)``.

For the aggregated reports (P11, P12) only the set of
``(table_name, predicate_column, job_id)`` triples matters, so each side is
reduced to its distinct join keys before the joins: repeated sub-steps no
longer multiply rows, and the counts are computed from distinct triples
(partial aggregation per key, so a table read by a third of all jobs is still
spread over tasks by ``job_id``).  The listing (P14) keeps the reference's
row-for-row join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import plan_text as pt
from slotwise.operators.staging import staged

JOB_KEYS = ("project_id", "user_email", "job_id")
STEP_KEYS = ("project_id", "user_email", "job_id", "stage_name", "kind")
PLAN_JOB_COLUMNS = ("project_id", "user_email", "job_id", "job_type", "total_slot_ms", "query")
STAGE_COLUMNS = (
    "stage_name",
    "id",
    "shuffle_output_bytes",
    "shuffle_output_bytes_spilled",
    "records_read",
    "records_written",
    "parallel_inputs",
)
LISTING_COLUMNS = (
    "project_id",
    "user_email",
    "job_id",
    "job_type",
    "total_slot_ms",
    "query",
    "shuffle_output_bytes",
    "shuffle_output_bytes_spilled",
    "records_read",
    "records_written",
    "parallel_inputs",
    "stage_name",
    "substep",
    "table_name",
    "predicate_column",
)


def plan_substeps(jobs: DataFrame, job_columns: Sequence[str] = PLAN_JOB_COLUMNS) -> DataFrame:
    """One row per (stage, step, sub-step) with job and stage columns.

    Three inner explodes (no shuffle): jobs without stages, stages without
    steps and steps without sub-steps produce no rows.
    """
    job_columns = list(job_columns)
    stages = jobs.select(*job_columns, F.explode("job_stages").alias("js"))
    steps = stages.select(
        *job_columns,
        F.col("js.name").alias("stage_name"),
        *[F.col(f"js.{c}").alias(c) for c in STAGE_COLUMNS[1:]],
        F.explode("js.steps").alias("st"),
    )
    return steps.select(
        *job_columns,
        *STAGE_COLUMNS,
        F.col("st.kind").alias("kind"),
        F.explode("st.substeps").alias("substep"),
    )


def read_steps(substeps: DataFrame) -> DataFrame:
    """C11: sub-steps of READ steps in stages whose name ends with 'Input'."""
    return substeps.filter(
        (F.col("kind") == F.lit(pt.READ_KIND)) & F.col("stage_name").endswith(pt.INPUT_STAGE_SUFFIX)
    )


def step_tables(rs: DataFrame) -> DataFrame:
    """``FROM x`` sub-steps with ``table_name``."""
    return rs.filter(F.col("substep").startswith(pt.FROM_PREFIX)).withColumn(
        "table_name", pt.table_name(F.col("substep"))
    )


def step_columns(rs: DataFrame, strict: bool = True, trim: bool = False) -> DataFrame:
    """One row per ``$k:col`` pair with ``param``, ``key`` and ``col``."""
    cols = rs.filter(F.col("substep").startswith(pt.COLUMNS_PREFIX)).withColumn(
        "param", F.explode(pt.column_params(F.col("substep"), trim=trim))
    )
    return cols.withColumns(
        {
            "key": pt.param_key(F.col("param"), strict=strict),
            "col": pt.param_column(F.col("param"), strict=strict),
        }
    )


def step_predicates(rs: DataFrame) -> DataFrame:
    """C14: one row per ``$k`` occurrence in a WHERE sub-step (repeats kept)."""
    return rs.filter(F.col("substep").startswith(pt.WHERE_PREFIX)).withColumn(
        "predicate_key", F.explode(pt.predicate_keys(F.col("substep")))
    )


def table_predicates(rs: DataFrame, strict: bool = True, trim: bool = False) -> DataFrame:
    """C15 (listing form): predicate -> column -> table, row for row.

    Predicates meet columns on the step keys and the parameter, and tables on the step keys.
    """
    names = step_columns(rs, strict=strict, trim=trim).select(*STEP_KEYS, F.col("key").alias("predicate_key"), "col")
    tables = step_tables(rs).select(*STEP_KEYS, "table_name")
    found = step_predicates(rs).join(names, [*STEP_KEYS, "predicate_key"]).join(tables, list(STEP_KEYS))
    return found.select(
        *[c for c in LISTING_COLUMNS if c not in ("predicate_column",)],
        F.col("col").alias("predicate_column"),
    )


def predicate_triples(rs: DataFrame, strict: bool = True, trim: bool = False) -> DataFrame:
    """C15 (aggregation form): distinct ``(table_name, predicate_column, job_id)``.

    Same rows as ``table_predicates(...).select(...).distinct()`` but every
    side is reduced to its distinct keys first.
    """
    names = step_columns(rs, strict=strict, trim=trim).select(*STEP_KEYS, F.col("key").alias("predicate_key"), "col").distinct()
    tables = step_tables(rs).select(*STEP_KEYS, "table_name").distinct()
    filters = step_predicates(rs).select(*STEP_KEYS, "predicate_key").distinct()
    found = filters.join(names, [*STEP_KEYS, "predicate_key"]).join(tables, list(STEP_KEYS))
    return found.select("table_name", F.col("col").alias("predicate_column"), "job_id").distinct()


def table_readers(rs: DataFrame) -> DataFrame:
    """Distinct ``(table_name, job_id)`` of every job reading a table."""
    return step_tables(rs).select("table_name", "job_id").distinct()


TABLE_LEVEL, COLUMN_LEVEL = 0, 1


def usage_levels(triples: DataFrame, table_jobs: DataFrame | None = None) -> DataFrame:
    """Stack ``(table_name, job_id)`` rows (level 0) on the triples (level 1)."""
    if table_jobs is None:
        table_jobs = triples.select("table_name", "job_id")
    t = table_jobs.select(
        "table_name", F.lit(None).cast("string").alias("predicate_column"), F.lit(TABLE_LEVEL).alias("level"), "job_id"
    )
    c = triples.select("table_name", "predicate_column", F.lit(COLUMN_LEVEL).alias("level"), "job_id")
    return t.unionByName(c)


def predicate_ratio(levels: DataFrame, distinct: bool = True, table_storage: DataFrame | None = None) -> DataFrame:
    """Distinct-job counts per table and per (table, column), and their ratio, in order.

    ``table_storage`` adds table sizes (J9) before the final sort.

    ``levels`` holds ``(table_name, predicate_column, level, job_id)``: level 0
    rows are the denominator's table readers, level 1 rows the (table, column)
    uses.  ``distinct=False`` is for level rows that are already distinct
    (the in-row form deduplicates within each job row): the count then
    pre-aggregates map-side and only a few rows per task are shuffled.  One distinct and one grouped count serve both levels (a hot table
    is spread over tasks by ``job_id`` in the distinct, and pre-counted
    map-side in the count); the two count sets are small and joined on
    ``table_name`` (NULL names drop out, as with the reference's ``using``).
    """
    rows = levels.distinct() if distinct else levels
    counted = rows.groupBy("level", "table_name", "predicate_column").agg(F.count("job_id").alias("cnt"))
    # The counted rows are few (one per table and per table column); the
    # table count is spread onto its column rows with a window instead of a
    # self-join, so the counting plan runs once.
    per_table = Window.partitionBy("table_name")
    table_used = F.max(F.when(F.col("level") == TABLE_LEVEL, F.col("cnt"))).over(per_table)
    j = (
        counted.filter(F.col("table_name").isNotNull())
        .withColumn("table_used_cnt", table_used)
        .filter((F.col("level") == COLUMN_LEVEL) & F.col("table_used_cnt").isNotNull())
        .withColumnRenamed("cnt", "predicate_used_cnt")
    )
    out = j.select(
        "table_name",
        "predicate_column",
        "table_used_cnt",
        "predicate_used_cnt",
        (F.col("predicate_used_cnt") / F.col("table_used_cnt")).alias("column_used_ratio"),
    )
    if table_storage is not None:
        out = with_table_sizes(out, table_storage)
    return out.orderBy(
        F.asc_nulls_first("column_used_ratio"),
        F.asc_nulls_first("table_used_cnt"),
        F.desc_nulls_last("predicate_used_cnt"),
    )


def with_table_sizes(report: DataFrame, table_storage: DataFrame) -> DataFrame:
    """Left join of a report with table sizes on ``table_name``.

    The storage catalog has one row per table; several projects or datasets
    may share a table name, so the join can repeat a report row, as the
    reference's ``using (table_name)`` would.
    """
    sizes = table_storage.select(
        "table_name", "total_rows", "total_partitions", "total_logical_bytes", "total_physical_bytes"
    )
    columns = [*report.columns, *(c for c in sizes.columns if c != "table_name")]
    return report.join(sizes, "table_name", "left").select(*columns)


# ----------------------------------------------------------------------------
# In-row form: the five join keys all come from one job row, so the
# predicate -> column -> table matching can run inside the row over its
# ``job_stages`` array (no explode of the whole plan, no join, no shuffle).
# It equals the join form where a job's keys are on one row; input stages of one
# name share their columns and tables inside the row.  The aggregated reports
# bring the parsed stages of a job's rows together first; for the listing
# ``split_regular`` tells rows with the keys of another from the rest, and they take the join form.

#: Bits that the keys of repeated jobs are spread over, in blocks of 4 KB (16 MB in all).
REPEAT_BITS = 1 << 27


def with_keys(jobs: DataFrame) -> DataFrame:
    """Jobs whose three keys are known; equi-joins on the keys drop the others."""
    return jobs.filter(" AND ".join(f"{c} IS NOT NULL" for c in JOB_KEYS))


def _repeat_bit() -> Column:
    return F.pmod(F.xxhash64(*JOB_KEYS), F.lit(REPEAT_BITS))


def repeated_bits(jobs: DataFrame) -> DataFrame | None:
    """Blocks of bits, set for the hashed keys that are on several rows (None if none are).

    One grouped count over the keys' hashes decides; it is a job of its own and reads the keys only.
    However many keys repeat, the blocks have at most ``REPEAT_BITS`` bits, so they can be broadcast.
    """
    again = jobs.select(F.xxhash64(*JOB_KEYS).alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    bit = F.pmod("_hash", F.lit(REPEAT_BITS))
    # The positions are shuffled, not partial blocks, of which every task would have nearly all.
    positions = again.select(F.bitmap_bucket_number(bit).alias("_block"), F.bitmap_bit_position(bit).alias("_at")).repartition("_block")
    blocks = staged(positions.groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_bits")), "repeated-jobs")
    return None if blocks.isEmpty() else blocks


def split_regular(jobs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows fit for the in-row form, and the others (None if there are none).

    The bit of a row's keys decides, in place and without a shuffle.  Rows of one job go the same
    way; a job that shares its bit with a repeated one is among the others, whose form suits any job.
    """
    blocks = repeated_bits(jobs)
    if blocks is None:
        return jobs, None
    at = F.bitmap_bit_position(_repeat_bit())
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    again = (F.col("_block") == F.bitmap_bucket_number(_repeat_bit())) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    blocks = F.broadcast(blocks)
    return jobs.join(blocks, again, "left_anti"), jobs.join(blocks, again, "left_semi")


def _exploded(df: DataFrame, keep: Sequence[str], array: Column, name: str) -> DataFrame:
    """``keep`` and one row per (never NULL) element of a computed array.

    A plain ``explode`` makes the optimizer push a filter on the array's size down
    to the scan, which would compute the array twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def _input_stages() -> Column:
    """Per input stage: its scalar fields and its parsed READ sub-steps, never NULL."""
    return F.filter(F.col("job_stages"), lambda s: s["name"].endswith(pt.INPUT_STAGE_SUFFIX))


def _read_substeps(stage: Column) -> Column:
    reads = F.filter(stage["steps"], lambda st: (st["kind"] == F.lit(pt.READ_KIND)) & st["substeps"].isNotNull())
    return F.coalesce(F.flatten(F.transform(reads, lambda st: st["substeps"])), F.array().cast("array<string>"))


def _tables(subs: Column) -> Column:
    return F.transform(F.filter(subs, lambda x: x.startswith(pt.FROM_PREFIX)), pt.table_name)


def _column_pairs(subs: Column, strict: bool, trim: bool) -> Column:
    lists = F.filter(subs, lambda x: x.startswith(pt.COLUMNS_PREFIX))
    return F.flatten(
        F.transform(
            lists,
            lambda x: F.transform(
                pt.column_params(x, trim=trim),
                lambda p: F.struct(
                    pt.param_key(p, strict=strict).alias("key"), pt.param_column(p, strict=strict).alias("col")
                ),
            ),
        )
    )


def _predicate_keys(subs: Column) -> Column:
    return F.flatten(F.transform(F.filter(subs, lambda x: x.startswith(pt.WHERE_PREFIX)), pt.predicate_keys))


def _row_pairs(x: Column) -> Column:
    """(table_name, predicate_column) pairs of one parsed stage."""
    matched = F.filter(x["cols"], lambda c: F.array_contains(x["keys"], c["key"]))
    return F.flatten(
        F.transform(
            x["tables"],
            lambda t: F.transform(matched, lambda c: F.struct(t.alias("table_name"), c["col"].alias("predicate_column"))),
        )
    )


def _per_job(parsed: DataFrame) -> DataFrame:
    """One row per job id with the parsed stages of all its rows; stages of one step key share their columns and predicates.

    Equal rows merge before the shuffle, so an id on very many rows is one partial set a task;
    a group holds the distinct plans of one id.
    """
    grouped = parsed.filter("job_id IS NOT NULL").groupBy("job_id").agg(F.flatten(F.collect_set("_p")).alias("_p"))

    def key(x: Column) -> Column:
        return F.struct(x["project_id"], x["user_email"], x["stage_name"])

    def of_key(x: Column, field: str) -> Column:
        return F.flatten(F.transform(F.filter(F.col("_p"), lambda y: key(y) == key(x)), lambda y: y[field]))

    def shared(x: Column) -> Column:
        own = ("project_id", "user_email", "stage_name", "tables")
        return F.struct(*(x[f].alias(f) for f in own), of_key(x, "cols").alias("cols"), of_key(x, "keys").alias("keys"))

    clash = F.size(F.array_distinct(F.transform("_p", key))) < F.size("_p")
    return grouped.select("job_id", F.when(clash, F.transform("_p", shared)).otherwise(F.col("_p")).alias("_p"))


def usage_levels_in_row(
    jobs: DataFrame,
    strict: bool = True,
    trim: bool = False,
    denominator: str = "predicates",
    require_column: bool = False,
    unique_jobs: bool = False,
) -> DataFrame:
    """Level rows for :func:`predicate_ratio`, matched inside each job.

    The plans are parsed in their rows, in one scan, and meet by job id in one shuffle; so ids on
    several rows and stages that share a name match as in the join form.  Level rows are distinct
    per job (``array_distinct``) and need no ``distinct`` shuffle.  ``unique_jobs`` is for exports
    known to have one row per job and input stages of different names: no shuffle then.

    ``denominator="predicates"``: a table counts for a job when the job has a
    matched predicate on it (P11); ``"readers"``: when the job reads it (P12).
    A job with a NULL key reads its tables but matches no predicate.
    ``require_column`` drops pairs whose column is NULL (P12's final filter).
    """
    named = F.transform(_input_stages(), lambda s: F.struct(s["name"].alias("stage_name"), _read_substeps(s).alias("subs")))
    staged = jobs.select(*JOB_KEYS, named.alias("_subs"))
    parsed = staged.select(
        "job_id",
        F.transform(
            "_subs",
            lambda x: F.struct(
                F.col("project_id"),
                F.col("user_email"),
                x["stage_name"].alias("stage_name"),
                _tables(x["subs"]).alias("tables"),
                _column_pairs(x["subs"], strict, trim).alias("cols"),
                _predicate_keys(x["subs"]).alias("keys"),
            ),
        ).alias("_p"),
    )
    parsed = parsed if unique_jobs else _per_job(parsed)
    keyed = F.filter("_p", lambda x: x["project_id"].isNotNull() & x["user_email"].isNotNull())
    pairs = F.array_distinct(F.flatten(F.transform(F.when(F.col("job_id").isNotNull(), keyed), _row_pairs)))
    if require_column:
        pairs = F.filter(pairs, lambda pr: pr["predicate_column"].isNotNull())
    none = F.array().cast("array<struct<table_name:string,predicate_column:string>>")
    staged = parsed.select("job_id", "_p", F.coalesce(pairs, none).alias("_pairs"))
    if denominator == "predicates":
        tables = F.array_distinct(F.transform(F.col("_pairs"), lambda pr: pr["table_name"]))
    elif denominator == "readers":
        tables = F.array_distinct(F.flatten(F.transform(F.col("_p"), lambda x: x["tables"])))
    else:
        raise ValueError(f"denominator must be 'predicates' or 'readers', got {denominator!r}")
    level_rows = F.concat(
        F.transform(
            tables,
            lambda t: F.struct(
                t.alias("table_name"),
                F.lit(None).cast("string").alias("predicate_column"),
                F.lit(TABLE_LEVEL).alias("level"),
            ),
        ),
        F.transform(
            F.col("_pairs"),
            lambda pr: F.struct(
                pr["table_name"].alias("table_name"),
                pr["predicate_column"].alias("predicate_column"),
                F.lit(COLUMN_LEVEL).alias("level"),
            ),
        ),
    )
    return _exploded(staged, ["job_id"], level_rows, "lv").select("lv.table_name", "lv.predicate_column", "lv.level", "job_id")


def table_predicates_in_row(
    jobs: DataFrame,
    job_columns: Sequence[str] = PLAN_JOB_COLUMNS,
    strict: bool = True,
    trim: bool = False,
) -> DataFrame:
    """C15 listing without a join: one output row per reference join row.

    Each input stage becomes a row and is parsed once; then every WHERE sub-step,
    every ``$k`` in it, every column of that key and every table are exploded in
    turn, so no job's whole result is ever one array.  Where input stages of a row share
    a name, its plan goes along, and a stage takes the columns and tables of all of that name.
    """
    job_columns = list(job_columns)
    inputs = jobs.select(*job_columns, _input_stages().alias("_inputs"))
    names = F.transform("_inputs", lambda s: s["name"])
    clash = F.size(F.array_distinct(names)) < F.size(names)
    plan = F.transform("_inputs", lambda s: F.struct(s["name"].alias("name"), s["steps"].alias("steps")))
    stages = _exploded(inputs.withColumn("_plan", F.when(clash, plan)), [*job_columns, "_plan"], F.col("_inputs"), "js")
    fields = [F.col(f"js.{c}").alias(c) for c in STAGE_COLUMNS[2:]]
    scalars = [*job_columns, *STAGE_COLUMNS[2:], "stage_name"]
    named = stages.select(*job_columns, *fields, F.col("js.name").alias("stage_name"), "_plan", _read_substeps(F.col("js")).alias("_own"))
    of_name = F.filter("_plan", lambda s: s["name"] == F.col("stage_name"))
    subs = F.when(F.col("_plan").isNull(), F.col("_own")).otherwise(F.flatten(F.transform(of_name, _read_substeps)))
    shared = named.select(*scalars, "_own", subs.alias("_subs"))
    parsed = shared.select(
        *scalars,
        F.filter("_own", lambda x: x.startswith(pt.WHERE_PREFIX)).alias("_wheres"),
        _column_pairs(F.col("_subs"), strict, trim).alias("_cols"),
        F.transform(_tables(F.col("_subs")), lambda t: F.struct(t.alias("table_name"))).alias("_tables"),
    )
    wheres = _exploded(parsed, [*scalars, "_cols", "_tables"], F.col("_wheres"), "substep")
    keys = _exploded(wheres, [*scalars, "_cols", "_tables", "substep"], pt.predicate_keys(F.col("substep")), "_key")
    matched = F.filter("_cols", lambda c: c["key"] == F.col("_key"))
    cols = _exploded(keys, [*scalars, "_tables", "substep"], matched, "_col")
    cols = cols.withColumn("predicate_column", F.col("_col.col"))
    tables = _exploded(cols, [*scalars, "substep", "predicate_column"], F.col("_tables"), "_table").withColumn("table_name", F.col("_table.table_name"))
    return tables.select(*LISTING_COLUMNS)
