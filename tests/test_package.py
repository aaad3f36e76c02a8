from __future__ import annotations

import ast
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_llm():
    for p in (ROOT / "gridloom").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(a.name for a in node.names)] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 100 and df.columns == ["table_id", "ri", "ci", "text", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60
    assert all(isinstance(s, str) for s in entry.oracle_sql().values())


def test_plans_keep_to_the_jvm_and_push_down(spark):
    """The text rules and the reconstruction run without Python, and scans read only the columns they need."""
    for name in ("grid_reconstruct", "reconcile_journal", "text_norm", "ditto_expand", "dedup_numeric", "object_locator", "labelled_sheet_cells"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan, name
    plan = entry.queries()["row_count_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)" in plan and "o_totalprice" not in plan


@pytest.mark.parametrize(("name", "most"), [("grid_reconstruct", 1), ("fixed_row_anchor", 1), ("header_trim_footer_cut", 2), ("row_gap_cluster", 1)])
def test_one_exchange_serves_all_windows(spark, name, most):
    text = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\((?!kind)", text)) <= most, text
