"""What a query holds at once doesn't grow with its input."""

import re

import pytest

from tallyloom.plans import analyze, fact_queries, history_queries

DATA = "/root/testdata/sf0.001"


def test_joins_by_commit_hold_no_table_in_the_driver(spark):
    """Staged tables of a history are small on disk, and Spark goes by that size."""
    df = analyze.commit_facts(fact_queries.raw_records(spark, DATA), "code")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_each_path_is_classified_once(spark):
    """Rows look their class up: no pattern of the classification runs over them."""
    df = fact_queries.file_views(spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "generated_vendored" not in plan
    assert df.count() > 5000


@pytest.mark.parametrize("query", ["boundary_delta_multiset", "boundary_delta_rendered", "symbol_delta_cancel"])
def test_deltas_sort_few_rows_in_a_task_whatever_the_input(spark, monkeypatch, query):
    """One shuffle and two sorts, and partitions as many as the rows ask for: 6,000 rows by 100."""
    monkeypatch.setattr(history_queries, "PARTITION_ROWS", 100)
    plan = getattr(history_queries, query)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(sha#\d+L, (\d+)\)", plan) == ["60"] and plan.count("Exchange") == 1
    assert plan.count("Sort [") == 2


def test_entries_are_numbered_with_nulls_last(spark, tmp_path):
    row = "1L l_orderkey, {} l_partkey, 1L l_suppkey, 1 l_linenumber, 1D l_quantity, 1D l_extendedprice, 0D l_discount, 0D l_tax, 'A' l_returnflag, 'O' l_linestatus, timestamp_ntz'2001-01-01' l_shipdate"
    spark.sql("select " + row.format("cast(null as bigint)") + " union all select " + row.format("5L")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r["name"], r["ord"]) for r in history_queries.entries(spark, str(tmp_path)).collect()} == {("n5", 1), (None, 2)}


def test_shuffle_of_entries_is_written_without_sorting(spark, monkeypatch):
    monkeypatch.setattr(history_queries, "PARTITION_ROWS", 10)
    plan = history_queries.boundary_delta_multiset(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(sha#\d+L, (\d+)\)", plan) == ["200"]
