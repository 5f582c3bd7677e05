"""What must hold for the plan of every registered query."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrameWriter

from ledgerline.operators.indicators import latest_quote
from ledgerline.operators.quantiles import exact_quantiles
from ledgerline.plans.catalog import all_queries as queries
from ledgerline.plans.serving import curated


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of what a query writes on its way to the frame it returns."""
    plans: list[str] = []
    for method in ("parquet", "json", "text", "csv", "save"):
        plain = getattr(DataFrameWriter, method)

        def seen(self, *args, _plain=plain, **options):
            plans.append(plan_of(self._df))
            return _plain(self, *args, **options)

        monkeypatch.setattr(DataFrameWriter, method, seen)
    return plans


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_joins_and_no_python_rows(spark, sf_dir, name, written):
    result = plan_of(queries()[name](spark, sf_dir))
    for plan in [result, *written]:
        for operator in ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroups"]:
            assert operator not in plan, f"{name} uses {operator}"


def test_a_page_and_a_listing_shuffle_nothing(spark, sf_dir):
    for name in ["prices_page", "ticker_filter", "date_filter", "curated_scan", "batch_gate", "liquidity"]:
        assert "Exchange" not in plan_of(queries()[name](spark, sf_dir)).replace("AQEShuffleRead", ""), name


def test_ranks_shuffle_values_once(spark, sf_dir, written):
    """Counting is the only shuffle of rows; ranges are cut from the counted values."""
    rows = spark.range(5000).selectExpr("id % 3 k", "cast(id % 700 as double) v")
    exact_quantiles(rows, ["k"], "v", [0.5], range_rows=100).collect()
    assert [p.count("Exchange hashpartitioning") + p.count("Exchange rangepartitioning") for p in written] == [1, 1]


def test_rank_limits_run_before_the_shuffle(spark, sf_dir):
    """On stored rows each task sends only its own top rows per key."""
    frames = {
        "latest_quote": latest_quote(curated(spark, sf_dir)),
        **{name: queries()[name](spark, sf_dir) for name in ["sample_rows", "market_quota"]},
    }
    for name, frame in frames.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_paging_does_not_sort_everything(spark, sf_dir):
    for name in ["prices_page", "recent_desc", "preview_head", "companies_page", "risk_screen_top"]:
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan, name
