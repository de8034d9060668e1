"""Plan shapes that must hold at any scale (checked on sf0.001 after one execution)."""

from __future__ import annotations

import re

import pytest
from conftest import SF_SMALL

import __spark_entry__ as E


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_cutoff_reaches_the_scan(spark):
    plan = _plan(E.queries()["time_cutoff"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", plan)
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_history_at_one_t0_shuffles_once_by_person(spark):
    plan = _plan(E.queries()["history_at_horizon"](spark, SF_SMALL))
    shuffles = re.findall(r"Exchange hashpartitioning\(([^,]+),", plan)
    assert len(shuffles) == 1 and shuffles[0].startswith(("PersonId", "user_id"))
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_pairwise_joins(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
