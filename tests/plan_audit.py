"""Audit the physical plan of every registered query (no execution beyond
the bounded checks and checkpoints a query runs while it is built).

Usage: python tests/plan_audit.py [data_dir]
Prints one line per query: exchanges by kind, broadcasts, sort-merge joins,
and flags for nested-loop / Cartesian joins (must be none), Python UDFs (none)
and pushed scan filters.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def audit(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "hash_x": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range_x": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single_x": len(re.findall(r"Exchange SinglePartition", plan)),
        "bcast": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "pushed": len(re.findall(r"PushedFilters: \[[^\]]+\]", plan)),
        "wgl_partial": plan.count("WindowGroupLimit") and "Partial" in plan,
        "forbidden": [f for f in FORBIDDEN if f in plan],
    }


def main() -> None:
    data_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as e
    from profilebook.session import build_session
    spark = build_session()
    bad = 0
    for name, q in e.queries().items():
        a = audit(q(spark, data_dir))
        bad += bool(a["forbidden"])
        print(f"{name:28s} hashX={a['hash_x']:2d} rangeX={a['range_x']} singleX={a['single_x']} bcast={a['bcast']:2d} "
              f"smj={a['smj']:2d} bhj={a['bhj']:2d} pushed={a['pushed']:2d} forbidden={a['forbidden']}", flush=True)
    print("queries with forbidden operators:", bad)


if __name__ == "__main__":
    main()
