"""Result order of the sorted reports (O1-O4), which the oracle comparison ignores."""

import pytest

from slotwise.plans.registry import QUERIES

def up(v):
    """NULLs first."""
    return (0, 0) if v is None else (1, v)


def down(v):
    """NULLs last."""
    return (1, 0) if v is None else (0, -v)


ORDERS = {
    "elapsed_by_bytes_bucket": lambda r: up(r["bucket_bytes_processed"]),
    "slot_bucket_indicator": lambda r: up(r["total_slot_ms_bucket"]),
    "slot_utilization": lambda r: up(r["ctime_bucket"].timestamp()),
    "bucket_series": lambda r: up(r["ctime_bucket"].timestamp()),
    "minute_usage": lambda r: -r["stb"].timestamp(),
    "minute_usage_by_reservation": lambda r: -r["stb"].timestamp(),
    "most_used_queries": lambda r: -r["used_count"],
    "most_used_queries_concise": lambda r: -r["used_count"],
    "most_used_queries_spilled": lambda r: -r["used_count"],
    "most_used_queries_row_number": lambda r: -r["used_count"],
}
RATIO = [
    "most_used_predicates", "most_used_predicates_join", "most_used_predicates_project", "most_used_predicates_all_reads",
    "most_used_predicates_sizes",
]
ORDERS |= {name: lambda r: (up(r["column_used_ratio"]), up(r["table_used_cnt"]), down(r["predicate_used_cnt"])) for name in RATIO}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    keys = [ORDERS[name](r) for r in rows]
    assert len(keys) > 1 and keys == sorted(keys)


def test_sizes_keep_the_order_without_broadcast(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_rows_come_in_order(spark, sf_dir, "most_used_predicates_sizes")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
