"""Summarise the physical plan of every registered query (after AQE has
run it at the given scale) into a Markdown table.

    python tests/plan_report.py [/root/testdata/sf0.1] > PLANS.md
    python tests/plan_report.py /root/testdata/sf0.1 --scale-shape >> PLANS.md
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

OPS = ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
       "CartesianProduct", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window",
       "Generate", "StateStoreRestore", "StateStoreSave")


def summarise(plan: str) -> dict:
    ops = Counter()
    for line in plan.splitlines():
        s = re.sub(r"^\*\(\d+\) ", "", line.strip(" :+-"))
        for op in OPS:
            if s.startswith(op + " ") or s.startswith(op + "("):
                ops[op] += 1
    shuffles = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|Exchange SinglePartition", plan))
    broadcasts = plan.count("BroadcastExchange")
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
    pushed = [p for p in pushed if not all(x.strip().startswith("IsNotNull") for x in p.split(","))]
    codegen = len(re.findall(r"\*\(\d+\)", plan))
    return {"shuffles": shuffles, "broadcasts": broadcasts, "ops": ops, "pushed": pushed, "codegen": codegen}


def final_plan(df) -> str:
    """Run the DataFrame's own physical plan (so AQE finishes it) and
    return the final plan only."""
    executed = df._jdf.queryExecution().executedPlan()
    executed.execute().count()
    return drop_initial_plans(executed.toString())


def drop_initial_plans(plan: str) -> str:
    """Remove every ``== Initial Plan ==`` block (nested subqueries have
    their own), keeping the final plans."""
    kept, skip_at = [], None
    for line in plan.splitlines():
        col = len(line) - len(line.lstrip(" :|"))
        if skip_at is not None:
            if col > skip_at:
                continue
            skip_at = None
        if "== Initial Plan ==" in line:
            skip_at = col
            continue
        kept.append(line)
    return "\n".join(kept)


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    from fleetframe.session import get_session
    from fleetframe.plans.queries import QUERIES
    spark = get_session("local[8]", shuffle_partitions=8)
    if "--scale-shape" in sys.argv:
        # The join shape at scale: only the fixed-size dimensions (nation,
        # 25 rows; region, 5 rows) stay under the broadcast threshold, and
        # AQE's runtime conversion is off, so every other side is "large".
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4KB")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        print(f"## Scale shape at {sf_dir}: only nation and region broadcast, every other side large\n")
        table(spark, QUERIES, sf_dir)
        return
    print(f"# Physical plans at {sf_dir} (after AQE)\n")
    print("Generated by `tests/plan_report.py` from each query's final adaptive plan. "
          "Shuffles count hash, range, round-robin and single-partition exchanges; "
          "broadcasts include AQE's runtime conversions of measured small sides; codegen "
          "counts whole-stage codegen spans. A stream query has two rows: the stream's own "
          "last micro-batch, and the plan that folds its upsert log.\n")
    table(spark, QUERIES, sf_dir)


def table(spark, queries, sf_dir) -> None:
    from fleetframe.streaming import stateful
    streams, start = [], stateful.run_upserts

    def watched(*args, **kwargs):
        streams.append(start(*args, **kwargs))
        return streams[-1]

    stateful.run_upserts = watched
    print("| Query | Shuffles | Broadcasts | Operators | Codegen spans | Pushed filters |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name in sorted(queries):
        del streams[:]
        df = queries[name](spark, sf_dir)
        for q in streams:
            row(f"`{name}`, stream", drop_initial_plans(q._jsq.explainInternal(False)))
        row(f"`{name}`", final_plan(df))
    stateful.run_upserts = start


def row(name: str, plan: str) -> None:
    s = summarise(plan)
    ops = ", ".join(f"{k}×{v}" for k, v in sorted(s["ops"].items()))
    pushed = "; ".join(s["pushed"])[:160]
    print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {ops} | {s['codegen']} | {pushed} |")


if __name__ == "__main__":
    main()
