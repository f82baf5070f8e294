"""Plan guards: no registered query may use a cross product or a nested-loop
join, and the rolling plan must not window raw rows."""
import pytest

from conftest import SF0001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_products(spark):
    from taskwatch.catalog import QUERIES
    bad = {}
    for name, q in QUERIES.items():
        plan = _plan(q(spark, SF0001))
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_rolling_windows_run_on_buckets(spark):
    from taskwatch.catalog import rows
    from taskwatch.operators.rolling import rolling_stats
    plan = _plan(rolling_stats(rows(spark, SF0001), "task"))
    # windows read the pinned bucket table, never the task rows themselves
    assert "Window" in plan
    assert "events.parquet" not in plan
