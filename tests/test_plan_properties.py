"""Scale properties of the physical plans of every batch query."""
import re

import pytest

from basketry.plans import catalog  # noqa: F401
from basketry.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"
BATCH_MODULES = {"q_batch", "q_clean", "q_quality", "q_fraud", "q_live"}
BATCH = sorted(n for n, e in REGISTRY.items() if e.build.__module__.rsplit(".", 1)[-1] in BATCH_MODULES)
# unpartitioned windows are allowed only over tiny pre-aggregates
GLOBAL_WINDOW_OK = {"revenue_anomalies", "revenue_anomalies_calendar", "gold_value_segment"}


def plan_of(spark, name):
    return REGISTRY[name].build(spark, SF)._jdf.queryExecution().executedPlan().toString()


def unpartitioned_windows(plan):
    found = []
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
        first = spec.split(",")[0].strip()
        if " ASC" in first or " DESC" in first or first.startswith("specifiedwindowframe"):
            found.append(spec)
    return found


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_no_python_no_global_window(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas", plan)
    if name not in GLOBAL_WINDOW_OK:
        assert unpartitioned_windows(plan) == []


def test_gold_deduplicates_orders_once(spark):
    plan = plan_of(spark, "gold_segment_monthly")
    assert len(re.findall(r"key=\[order_id#\d+L\], functions=\[partial_min", plan)) == 1


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(spark, "category_performance")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    lineitem = [s for s in schemas if "l_orderkey" in s]
    assert lineitem and all("l_returnflag" not in s and "l_shipdate" not in s for s in lineitem)
