"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no group is gathered in one task
and nothing reaches the driver but two totals that tell when a step changed
nothing.  Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import skew_join, stage_table


def _star(pairs: DataFrame) -> DataFrame:
    """Give every (node, near) pair the smallest node that ``node`` sees, itself included."""
    low = pairs.groupBy("node").agg(F.min("near").alias("low")).withColumn("low", F.least("low", "node"))
    return skew_join(pairs, low, ["node"])  # a centre with very many copies may be split


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the smallest node reachable."""
    pair = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stage_table(links.filter("a <> b").select(pair.alias("p")).select("p.*").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        large = _star(both).filter("near > node").select(F.col("near").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        down = _star(large.select(F.col("a").alias("node"), F.col("b").alias("near")))
        small = down.select(F.col("near").alias("a"), F.col("low").alias("b")).unionByName(down.select(F.col("node").alias("a"), F.col("low").alias("b")))
        edges = stage_table(small.filter("a <> b").distinct(), "links")
        state, before = _state(edges), state
        if state == before:
            break
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
