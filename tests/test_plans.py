"""Physical plans: pushed filters, pruned columns, no pair joins, no unpartitioned windows."""

import pytest
from conftest import SMALL

from __spark_entry__ import queries

# These drain a stream, fit a model or write files before they return a frame.
EAGER = ("sessionlens.plans.streams",)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def names():
    own = {n: fn.__module__ for n, fn in queries().items() if fn.__module__.startswith("sessionlens.plans")}
    return [n for n, module in own.items() if not module.startswith(EAGER)]


def test_time_range_is_pushed_to_the_scan(spark):
    df = queries()["time_range"](spark, SMALL)
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


def test_newest_rows_are_cut_before_the_shuffle(spark):
    plan = plan_of(queries()["latest_per_user"](spark, SMALL))
    before_shuffle = plan.split("Exchange", 1)[1]
    assert "WindowGroupLimit" in before_shuffle


def test_the_flagship_shuffles_events_once(spark):
    plan = plan_of(queries()["user_risk_summary"](spark, SMALL))
    assert plan.count("Exchange hashpartitioning(user_id") == 1


@pytest.mark.parametrize("name", names())
def test_no_pair_join_and_no_single_task_window(spark, name):
    plan = plan_of(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if " Window [" in line and "windowspecdefinition(" in line:
            spec = line.split("windowspecdefinition(", 1)[1]
            assert not spec.lstrip().startswith("specifiedwindowframe"), line
            assert " ASC" not in spec.split(",")[0] and " DESC" not in spec.split(",")[0], line
