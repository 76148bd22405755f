"""Plan audit: per registered batch query, how often each table is scanned and
which plan nodes deserve a look (cartesian / nested-loop joins, single-partition
exchanges, Python evaluation, scalar subqueries).

usage: python tools/plan_audit.py [sf_dir] [query ...]
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FLAGS = ["CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition", "ArrowEvalPython",
         "BatchEvalPython", "FlatMapGroupsInPandas", "SortAggregate", "Subquery"]


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.001"
    from tidemark.plans.catalog import QUERIES
    from tidemark.session import build_session

    spark = build_session("local[8]", 16, app_name="tidemark-plan-audit")
    for name in args or sorted(QUERIES):
        if name.startswith(("stream_", "roundtrip_")):
            continue   # these write at build time
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        scans = collections.Counter(re.findall(r"/(\w+)\.parquet\]", plan))
        multi = {t: n for t, n in scans.items() if n > 1}
        flags = [f"{f}={plan.count(f)}" for f in FLAGS if plan.count(f)]
        print(f"{name:32s} scans={dict(scans)} {'MULTI ' + str(multi) if multi else ''} {' '.join(flags)}")


if __name__ == "__main__":
    main()
