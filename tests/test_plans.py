"""Plans of the headline queries: shuffles, pruned scans, and no job while a view is built."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerscope.sources.tables import orders_transfer_view, txn_view
from tests.conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan, kind="hashpartitioning|rangepartitioning|SinglePartition|RoundRobin"):
    return re.findall(rf"\bExchange ({kind})\(?([^,)]*)", plan)


@pytest.fixture
def jobs(spark):
    spark.sparkContext.setJobGroup("plans", "plans")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup("plans"))
    yield lambda: len(set(tracker.getJobIdsForGroup("plans")) - before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_views_are_built_without_counting_customers(spark, jobs):
    """Reading a schema may start a job; the number of customers is a subquery, and absent where it is not read."""
    txn_view(spark, SF_SMALL), orders_transfer_view(spark, SF_SMALL)
    schema_reads = jobs()
    for name in ("events", "customer", "nation", "orders", "customer"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
    assert jobs() - schema_reads == schema_reads
    assert "Subquery" not in plan_of(txn_view(spark, SF_SMALL).select("customer_id", "amount"))
    assert "Subquery" in plan_of(txn_view(spark, SF_SMALL).select("counterparty_id"))


def test_customer_aggregate_shuffles_partial_sums_by_customer_only(spark):
    plan = plan_of(E.queries()["agg_customer"](spark, SF_SMALL))
    assert [k for _, k in exchanges(plan)] and all("customer_id" in k for _, k in exchanges(plan)) and len(exchanges(plan)) == 1
    assert plan.count("HashAggregate") >= 2
    read = re.search(r"ReadSchema: struct<([^>]*event_id[^>]*)>", plan).group(1)
    assert "props" not in read and "event_type" not in read


def test_sorts_are_by_range_on_all_columns(spark):
    plan = plan_of(E.queries()["sort_customer_time"](spark, SF_SMALL))
    ranges = re.findall(r"rangepartitioning\(([^)]*)\)", plan)
    assert len(ranges) == 1 and ranges[0].count("ASC") == 3 and not exchanges(plan, "hashpartitioning")


def test_features_have_one_exchange_of_whole_rows(spark):
    """All windows read one exchange by customer and slice; the others carry per-slice sums."""
    plan = plan_of(E.queries()["compute_features"](spark, SF_SMALL))
    by_slice = re.findall(r"Exchange hashpartitioning\(customer_id#\d+, _slice#\d+L[^)]*\), REPARTITION", plan)
    assert len(by_slice) == 1 and plan.count("SinglePartition") == 0


def test_filters_and_columns_reach_the_scan(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    plan = plan_of(txn_view(spark, SF_SMALL).where(F.col("timestamp") >= "2024-01-10").select("customer_id"))
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert len(read.split(",")) < len(ev.columns)
    assert "ts" in re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
