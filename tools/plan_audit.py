"""Walk every registered query's executed plan and flag shapes that do not
scale: nested-loop / cartesian joins, sort-based aggregation, single-partition
exchanges, windows (with their partition keys) and Python evaluation.

    python tools/plan_audit.py [sf_dir]

Streaming queries are skipped (their builders run the stream).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from arbiter.plans import load_all  # noqa: E402
from arbiter.session import local_session  # noqa: E402

PATTERNS = [
    "BroadcastNestedLoopJoin",
    "CartesianProduct",
    "SortAggregate",
    "SinglePartition",
    "Window [",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(cpus=8, shuffle_partitions=16)
    for name, q in load_all().items():
        if name.startswith("t") and "stream" in name:
            continue
        try:
            plan = q.build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} ERROR {str(e)[:200]}")
            continue
        flags = [f"{p.rstrip(' [')}x{plan.count(p)}" for p in PATTERNS if p in plan]
        windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan)
        parts = f" window-partitions={'|'.join(w[:60] for w in windows)}" if windows else ""
        print(f"{name:28s} exchanges={plan.count('Exchange')} {' '.join(flags)}{parts}")


if __name__ == "__main__":
    main()
