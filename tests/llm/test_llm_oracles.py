"""Operators that SQL can express, on whole tables."""

from __future__ import annotations

import pytest

from check import compare, connect
from ledgerline.llm.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, con, name):
    status, note = compare(spark, con, name, "/root/testdata/sf0.01")
    assert status == "ok", note


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_no_cross_joins(spark):
    for name in ["op3_license_scan", "op4_exact_dedup", "op5_warc", "op7_mixing", "op8_vp_tree"]:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_exact_dedup_runs_no_python(spark):
    plan = QUERIES["op4_exact_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
