"""Plan audit: for every registered query, count shuffles and flag plan shapes that do not scale.

Usage: python tests/plan_audit.py [sf_dir]
Per query: exchanges (shuffles), broadcast exchanges, nested-loop / cartesian joins,
single-partition exchanges (a global window or sort), pushed scan filters. The physical plan is
the final adaptive plan after one execution through the noop sink.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def audit(df) -> dict:
    df.collect()  # runs this very plan; a noop write would run another one
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=false" not in plan
    plan = plan.split("== Initial Plan ==")[0]
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "nested_loop": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "single_partition": plan.count("Exchange SinglePartition"),
        "pushed_filters": sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))[:3],
    }


def main() -> None:
    from __spark_entry__ import queries
    from eventide.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    only = sys.argv[2:]
    for name, fn in queries().items():
        if only and name not in only:
            continue
        a = audit(fn(spark, sf))
        print(f"{name:26s} shuffles={a['shuffles']:3d} bcast={a['broadcasts']:2d} "
              f"nlj={a['nested_loop']} single={a['single_partition']} pushed={a['pushed_filters']}")
    spark.stop()


if __name__ == "__main__":
    main()
