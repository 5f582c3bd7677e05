"""Every registered query against its DuckDB statement, on whole tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from check import compare, connect
from ledgerline.plans.catalog import all_oracles as oracle_sql
from ledgerline.plans.catalog import all_queries as queries

LARGER = "/root/testdata/sf0.01"
WITHOUT_SQL = {
    "train_lr",
    "train_rf",
    "train_gbt",
    "train_mlp",
    "train_loss",
    "feature_importance",
    "score_companies",
    "risk_factors",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, con, sf_dir, name):
    status, note = compare(spark, con, name, sf_dir)
    if status == "EMPTY":
        # The smallest scale may leave a filter without hits: then it must have some on the next.
        status, note = compare(spark, connect(LARGER), name, LARGER)
    assert status == "ok", note


def test_only_model_fits_go_without_sql():
    assert set(queries()) - set(oracle_sql()) == WITHOUT_SQL


def test_entry_returns_one_quote_per_ticker(spark):
    quotes = entry(spark)
    assert quotes.count() == 25
    assert quotes.columns[:3] == ["ticker", "trading_date", "close_price"]
