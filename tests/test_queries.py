"""Every registered query that has SQL gives the same rows as DuckDB, without row UDFs or cross joins."""

import pytest
from check_queries import connect, differences

import __spark_entry__ as entry

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# Their SQL computes the large-sample KS tail, which applies to over 10,000 rows.
NEEDS_ROWS = {"drift_report", "drift_stored", "drift_summary"}
# Hundreds of trees: the operators are tested with few in test_models.py, the queries by tools/check_queries.py.
LONG = {"train_forest", "train_boosted", "compare_models"}


@pytest.fixture(scope="module")
def databases():
    return {folder: connect(folder) for folder in (SMALL, LARGE)}


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LONG))
def test_query_equals_its_sql(spark, databases, name):
    folder = LARGE if name in NEEDS_ROWS else SMALL
    assert differences(spark, databases[folder], folder, name) is None


def test_every_sql_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_five_rows_per_job(spark):
    rows = entry.entry(spark).collect()
    assert rows and max(r["rank"] for r in rows) == 5
