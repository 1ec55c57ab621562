"""Exact percentiles of big groups, without gathering a group.

``percentile_disc(p)`` is the smallest value ``v`` with
``count(x <= v) >= ceil(p * n)`` (NULLs ignored), so the value of one rank;
``percentile_cont(p)`` lies between the values of the two ranks next to
``1 + p * (n - 1)``.  The grouped aggregates keep a value -> count map per group and
merge all of them in one task.  This operator selects ranks instead:

1. equal values are counted (partial sums in each task, so a value on a third of
   all rows is one partial row per task), and the counts are range-partitioned by (group,
   column, value) with sampled splitters and written to the shared folder, once;
2. the rows of each range are summed per group and column; running sums over the ranges,
   few rows, tell which range holds a rank and which rank it is there;
3. only the ranges that hold a rank are read again: running counts inside them give
   the value.

No task holds more of a group than one range.  The written values are the only job
that runs while a report is built; all the rest is one lazy plan, whatever the
number of groups and targets.

NaN counts as larger than any other value and as one value, as Spark orders it.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.operators.staging import staged

Targets = dict[str, tuple[str, float]]  # output column -> (value column, p)


def rank_for(p: float, n: int) -> int:
    """1-based rank of ``percentile_disc(p)`` among ``n`` values (exact arithmetic)."""
    r = Fraction(str(p)) * n
    k = r.numerator // r.denominator + (1 if r.numerator % r.denominator else 0)
    return max(1, min(n, k))


def _counted_ranges(df: DataFrame, by: Sequence[str], columns: Sequence[str], ranges: int | None) -> DataFrame:
    """(by..., c, v, n, seg): each value of each column with its count, and the range that it lies in."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(x).cast("double").alias("v")) for i, x in enumerate(columns)]))
    rows = df.select(*by, values.alias("cv")).select(*by, "cv.*")  # NULLs stay: a group may have nothing else
    counts = rows.groupBy(*by, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    place = [*by, "c", "v"]
    ranged = counts.repartitionByRange(ranges, *place) if ranges else counts.repartitionByRange(*place)
    return staged(ranged.withColumn("seg", F.spark_partition_id()), "values", ["seg"])


def _wanted(targets: Targets, columns: Sequence[str], kind: str) -> Column:
    """The ranks (t, rank, weight) that the targets of column ``c`` ask for among ``total`` values, exactly."""
    total = F.col("total").cast("decimal(18,0)")
    asked = []
    for t, (column, p) in enumerate(targets.values()):
        exact = F.lit(Decimal(str(float(p)))).cast("decimal(20,18)")
        if kind == "disc":
            rank = F.greatest(F.lit(1), F.least(F.col("total"), F.ceil(exact * total).cast("long")))
            pairs = [(rank, F.lit(1.0), F.lit(True))]
        else:
            place = exact * (F.col("total") - 1).cast("decimal(18,0)")
            low = F.floor(place).cast("long")
            part = (place - low.cast("decimal(18,0)")).cast("double")
            pairs = [(low + 1, 1.0 - part, F.lit(True)), (low + 2, part, part > 0)]
        here = F.col("c") == columns.index(column)
        asked += [F.when(here & some, F.struct(F.lit(t).alias("t"), rank.alias("rank"), weight.alias("weight"))) for rank, weight, some in pairs]
    return F.filter(F.array(*asked), lambda x: x.isNotNull())


def exact_percentiles(df: DataFrame, targets: Targets, by: Sequence[str] = (), fanout: int | None = None, kind: str = "disc") -> DataFrame:
    """One row per group with a percentile of a column for each ``name -> (column, p)``; one row without ``by``.

    ``kind`` is ``disc`` or ``cont``; ``fanout`` is the number of ranges (default: Spark's shuffle partitions).
    """
    if kind not in ("disc", "cont"):
        raise ValueError(f"kind must be 'disc' or 'cont', got {kind!r}")
    by = list(by)
    columns = list(dict.fromkeys(c for c, _ in targets.values()))
    values = _counted_ranges(df, by, columns, fanout)
    known = values.filter("v is not null")

    over = Window.partitionBy(*by, "c")
    sums = known.groupBy(*by, "c", "seg").agg(F.sum("n").alias("held"))
    sums = sums.withColumns({"total": F.sum("held").over(over), "upto": F.sum("held").over(over.orderBy("seg"))})
    asked = sums.select(*by, "c", "seg", "held", (F.col("upto") - F.col("held")).alias("before"), F.explode(_wanted(targets, columns, kind)).alias("x"))
    inside = F.col("x.rank") - F.col("before")
    asked = asked.filter((inside > 0) & (inside <= F.col("held")))
    renamed = [F.col(b).alias(f"_of_{b}") for b in by]
    asked = asked.select(*renamed, F.col("c").alias("_of_c"), F.col("seg").alias("_of_seg"), "x.t", "x.weight", inside.alias("rank"))

    meets = (F.col("c") == F.col("_of_c")) & (F.col("seg") == F.col("_of_seg"))
    for b in by:
        meets &= F.col(b).eqNullSafe(F.col(f"_of_{b}"))
    held = Window.partitionBy(*by, "c", "seg", "t", "rank").orderBy("v")
    found = known.join(asked, meets).withColumn("at", F.sum("n").over(held))
    found = found.filter((F.col("rank") <= F.col("at")) & (F.col("rank") > F.col("at") - F.col("n")))
    shares = [F.sum(F.when(F.col("t") == t, F.col("v") * F.col("weight"))).alias(name) for t, name in enumerate(targets)]
    if not by:
        return found.agg(*shares)
    groups = values.select(*(F.col(b).alias(f"_of_{b}") for b in by)).distinct()
    same = F.lit(True)
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_of_{b}"))
    return groups.join(found.groupBy(*by).agg(*shares), same, "left").select(*(F.col(f"_of_{b}").alias(b) for b in by), *targets)


def exact_percentile_disc(df: DataFrame, x: str, names: dict[float, str], fanout: int | None = None) -> DataFrame:
    """One row with ``percentile_disc(p)`` of column ``x`` for each ``p -> name``."""
    return exact_percentiles(df, {name: (x, p) for p, name in names.items()}, fanout=fanout)
