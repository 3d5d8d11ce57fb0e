"""The shape of the plans: what is shuffled, broadcast, sorted and pushed down."""

import re

import __spark_entry__ as entry
from weighyard.operators import hourly, hourstats, rolling
from weighyard.plans import scorecard
from weighyard.plans.joins import lookup_join
from weighyard.session import shared_dir
from weighyard.sources import tables

SF = "/root/testdata/sf0.001"
def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return re.findall(r"Exchange (\w+)", re.sub(r"BroadcastExchange", "", plan))


def test_tally_and_battery_shuffle_twice(spark):
    frame = hourly.hour_frame(tables.from_events(spark, SF))
    assert shuffles(plan_of(frame)) == ["hashpartitioning"] * 2
    assert shuffles(plan_of(hourstats.battery(frame))) == ["hashpartitioning"] * 2
    assert shuffles(plan_of(hourstats.cumulative(frame))) == ["hashpartitioning"] * 2


def test_scorecard_shuffles_three_times_and_scans_once(spark):
    plan = plan_of(scorecard.daily_scorecard(tables.from_events(spark, SF), "2024-02-01"))
    assert shuffles(plan) == ["hashpartitioning"] * 3
    assert plan.count("FileScan") == 1
    # Tickets are reduced by hashing before the first shuffle; nothing sorts them.
    below = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "HashAggregate" in below and "Sort" not in below


def test_rolling_windows_have_no_single_partition(spark):
    plan = plan_of(rolling.rolling_baseline(tables.from_lineitem(spark, SF)))
    assert "SinglePartition" not in plan and "Window" not in plan and shuffles(plan) == ["hashpartitioning"] * 2


def test_scan_reads_only_what_is_needed(spark):
    plan = plan_of(rolling.rolling_trend(tables.from_lineitem(spark, SF)))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan


def test_lookup_is_broadcast_only_within_its_bound(spark):
    facts = spark.range(1000).selectExpr("id", "id % 50 AS k")
    lookup = spark.range(50).selectExpr("id AS k", "id * 2 AS v")
    small, big = lookup_join(facts, lookup, "k"), lookup_join(facts, lookup, "k", max_rows=10)
    assert "BroadcastHashJoin" in plan_of(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(big)
        assert sorted(map(tuple, big.collect())) == sorted(map(tuple, small.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_working_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    corpus = set(entry.corpus_queries())  # those without SQL have brute-force tests of their own
    without = set(entry.queries()) - set(entry.oracle_sql()) - corpus
    assert without == {"model_predictions", "model_trend_outlook"}
