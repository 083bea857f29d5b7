"""Shapes of physical plans that matter at scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d", n)])
def test_no_product_and_no_row_python(spark, name):
    if name.startswith("stream_"):
        pytest.skip("the plan is that of the stored output")
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in ("decode_packets", "decode_lora", "undecodable_packets", "valve_timeline", "valve_report"):
        assert "Python" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("name", ["rollup_mean_5m", "rollup_last", "rollup_all_specs", "upsert_points", "latest_board"])
def test_partial_hash_aggregates(spark, name):
    plan = plan_of(spark, name)
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "partial_" in plan


def test_time_range_reaches_the_scan(spark):
    plan = plan_of(spark, "time_range")
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed


def test_columns_are_pruned(spark):
    schema = plan_of(spark, "rollup_mean_5m").split("ReadSchema: ")[1]
    assert "props" not in schema.splitlines()[0]


def test_one_scan_and_one_exchange_for_all_specs(spark):
    plan = plan_of(spark, "rollup_all_specs")
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan


def test_windows_are_sliced(spark):
    """Rows of one sensor spread over many tasks: the exchange of the rows is by sensor and slice."""
    for name in ("since_last", "carry_forward", "silence_gaps"):
        plan = plan_of(spark, name)
        assert "_slice" in plan.split("Union")[0].split("Exchange hashpartitioning(")[1].split(")")[0]
