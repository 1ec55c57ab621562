"""Every registered report against its DuckDB oracle (row count, columns, values)."""

import pytest

import __spark_entry__ as entry
from oracle_compare import compare, duck_connection
from slotwise.plans.registry import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    return duck_connection(sf_dir)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_report_matches_oracle(spark, sf_dir, duck, name):
    result = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir, duck)
    assert result["columns_match"], result
    assert result["spark_rows"] == result["oracle_rows"], result
    assert result["values_match"], result


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "ctime_bucket"
    assert df.count() >= 0
