"""Plan shape checks at scale-relevant points: no nested-loop or
cartesian joins, no Python in batch plans, no single-partition windows,
filters and pruning reach the scans."""

import pytest

from fleetframe.plans.queries import QUERIES
from tests.conftest import SF_SMALL

NAMES = sorted(QUERIES)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_bad_operators(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad}"
    # One partition is allowed only to finish a global aggregate whose
    # partial step already ran on every map task (a scalar subquery).
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "partial_" in lines[i + 1], f"{name}: {line.strip()}"


def test_worker_filter_pushes_startswith(spark):
    plan = _plan(QUERIES["worker_filter"](spark, SF_SMALL))
    assert "StringStartsWith(c_name,Customer#0000001)" in plan


def test_scans_are_pruned(spark):
    plan = _plan(QUERIES["null_default"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan or "struct<doc_id:bigint,lang:string>" in plan
    assert "text" not in plan.split("documents.parquet")[1].split("\n")[0]


def test_runs_move_their_rows_once(spark):
    """The per-bucket edges come from the exchange that the rows use."""
    df = QUERIES["delimiter_runs"](spark, SF_SMALL)
    df.collect()
    assert "ReusedExchange" in _plan(df)
