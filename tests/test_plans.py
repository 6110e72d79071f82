"""Plan audit over every registered query: what the physical plan must not contain.

* no Python evaluation (row-at-a-time or Arrow UDFs): everything stays JVM-side;
* no Cartesian product;
* scans read only the columns they need (``ReadSchema`` pruned);
* no window without PARTITION BY over the rows: the only unpartitioned
  windows allowed run over the one-row-per-bucket carry tables (ordered
  by ``__bucket``) or over the handful of model rows.
"""

import re

import pytest

from conftest import SF_SMALL
from spendlens.plans.queries import QUERIES

MODEL_QUERIES = {"forest_fit", "boosting_fit", "ml_model_comparison", "grid_search", "feature_importance"}
NEEDS_ALL_LINEITEM = {"lineitem_missing", "lineitem_duplicates_all"}
# Results that are the fitted model's own rows (coefficients): the fit reads the tables, the result does not.
MODEL_OUTPUT = {"ols_full"}
# Results in key order: the tables are read into a stored, range-partitioned copy while the query is built.
STORED = {"prediction_file", "file_order_fill", "file_order_series", "ordered_fill", "events_fill", "test_series", "label_encode", "batch_score", "encode_unseen", "standardise"}
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct")
WINDOW = re.compile(r"Window \[.*\], \[(.*?)\], \[(.*?)\]\s*$")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(node, out):
    """(path, required column names) of every parquet scan in a physical plan."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _scans(node.inputPlan(), out)
    if name == "FileSourceScanExec":
        path = node.relation().location().rootPaths().head().toString()
        out.append((path, list(node.requiredSchema().fieldNames())))
    for seq in (node.children(), node.innerChildren()):
        for i in range(seq.size()):
            _scans(seq.apply(i), out)
    return out


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL_QUERIES))
def test_plan_shape(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = _plan(df)
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad} in plan"
    scans = _scans(df._jdf.queryExecution().executedPlan(), [])
    assert scans or name in MODEL_OUTPUT | STORED, f"{name}: reads no table"
    for path, cols in scans:
        if path.endswith("lineitem.parquet") and name not in NEEDS_ALL_LINEITEM:
            assert len(cols) < 11, f"{name}: lineitem scan reads every column"
        if path.endswith("customer.parquet") and not name.startswith("read_"):
            assert "c_name" not in cols and "c_mktsegment" not in cols, (name, cols)
        if path.endswith("orders.parquet"):
            assert len(cols) <= 2, (name, cols)
        if path.endswith("events.parquet"):
            assert "props" not in cols, f"{name}: events scan reads the JSON column"
    for line in plan.splitlines():
        m = WINDOW.search(line.strip())
        if m and not m.group(1).strip():
            order = m.group(2)
            assert "__bucket" in order or "importance" in order or "model" in order, \
                f"{name}: unpartitioned window over rows: {line.strip()[:200]}"
