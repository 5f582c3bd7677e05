from __future__ import annotations

import datetime as dt

import pytest

from ledgerline.operators import serving
from ledgerline.schemas import CURATED
from ledgerline.sinks.curated import read_positions, write_curated
from ledgerline.sinks.reports import price_export, write_export, write_report
from ledgerline.sources.curated import read_curated
from ledgerline.sources.tables import first_tickers, in_file_order, read_universe


@pytest.fixture(scope="module")
def curated(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("serving") / "curated")
    rows = [
        (t, dt.datetime(2025, 1, d, h), 10.0, 12.0, 9.0, 10.0 + d, 100, None, 11.0, None)
        for t, days in {"FPT": range(1, 8), "VCB": [2], "001": [3]}.items()
        for d in days
        for h in ([0, 15] if (t, d) == ("FPT", 5) else [0])
    ]
    write_curated(spark.createDataFrame(rows, CURATED), root)
    return read_curated(spark, root)


@pytest.fixture(scope="module")
def universe(spark):
    return spark.createDataFrame(
        [("FPT", "FPT Corp", "HOSE", "Tech"), ("ZZZ", "No data", "HNX", "x")],
        "ticker string, name string, market string, sector string",
    )


def test_companies_are_enriched_from_the_universe(curated, universe):
    got = serving.companies_page(serving.companies(curated, universe))
    assert [tuple(r) for r in got.rows.collect()] == [
        ("001", None, None, None),
        ("FPT", "FPT Corp", "HOSE", "Tech"),
        ("VCB", None, None, None),
    ]
    assert got.total.first()[0] == 3


def test_price_pages(curated):
    first = serving.prices_page(curated, " fpt ", page=1, limit=3)
    second = serving.prices_page(curated, "FPT", page=2, limit=3)
    assert first.total.first()[0] == 8
    assert [r["trading_date"].day for r in first.rows.collect()] == [1, 2, 3]
    assert [r["trading_date"].day for r in second.rows.collect()] == [4, 5, 5]
    assert serving.prices_page(curated, "FPT", page=9, limit=3).rows.count() == 0


@pytest.mark.parametrize("bounds", [(None, None), ("2025-01-03", None), (None, "2025-05-10"), ("2025-02-11", "2025-02-20"),
                                    ("2025-01-31", "2025-04-01"), ("2024-01-01", "2026-01-01"), ("2025-06-01", "2025-07-01")])
def test_pages_by_month_equal_counted_pages(spark, tmp_path, bounds):
    """Months of different sizes, one without rows, bounds inside and outside of the data."""
    days = [dt.datetime(2025, m, d, h) for m, ds in {1: range(1, 32), 2: [5, 11, 20], 4: range(1, 11), 5: [1, 30]}.items() for d in ds for h in (0, 9)]
    rows = [(t, day, 10.0, 12.0, 9.0, 10.0, 100, None, 11.0, None) for t in ("FPT", "VCB") for day in days]
    frame, root = spark.createDataFrame(rows, CURATED), str(tmp_path / "curated")
    write_curated(frame, root, dates=frame)
    table, positions = read_curated(spark, root), read_positions(spark, root)
    assert table.count() == len(rows)
    for page in (1, 2, 5, 9):
        plain = serving.prices_page(table, "FPT", *bounds, page=page, limit=12)
        found = serving.prices_page(table, "FPT", *bounds, page=page, limit=12, positions=positions)
        assert found.rows.collect() == plain.rows.collect()
        assert found.total.first()[0] == plain.total.first()[0]


def test_a_late_page_reads_its_months_only(spark, tmp_path):
    days = [dt.datetime(2020 + y, m, d) for y in range(3) for m in range(1, 13) for d in range(1, 21)]
    frame = spark.createDataFrame([("FPT", day, 1.0, 1.0, 1.0, 1.0, 1, None, 1.0, None) for day in days], CURATED)
    root = str(tmp_path / "curated")
    write_curated(frame, root, dates=frame)
    page = serving.prices_page(read_curated(spark, root), "fpt", page=30, limit=20, positions=read_positions(spark, root))
    assert [r["trading_date"].isoformat()[:7] for r in page.rows.collect()] == ["2022-06"] * 20
    plan = page.rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(trading_date,2022-06-01" in plan and "LessThan(trading_date,2022-07-01" in plan
    # A write without dates leaves no positions that do not hold.
    write_curated(frame, root)
    assert read_positions(spark, root) is None


def test_pages_join_up(curated):
    pages = [serving.prices_page(curated, "FPT", page=p, limit=3).rows.collect() for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [3, 3, 2, 0]
    whole = serving.project(serving.price_filter(curated, "FPT")).orderBy("trading_date", "close_price").collect()
    assert [r["trading_date"] for p in pages for r in p] == [r["trading_date"] for r in whole]


def test_an_intraday_bar_on_the_end_date_lies_outside(curated):
    page = serving.prices_page(curated, "FPT", "2025-01-04", "2025-01-05")
    assert [r["close_price"] for r in page.rows.collect()] == [14.0, 15.0]
    assert page.total.first()[0] == 2


def test_pages_after_a_date_join_up(curated):
    seen, after = [], None
    while rows := serving.prices_after(curated, "FPT", after, limit=3).collect():
        seen += [r["trading_date"].day for r in rows]
        after = str(rows[-1]["trading_date"]) + " 23:59:59"
    assert seen == [1, 2, 3, 4, 5, 5, 6, 7]


def test_ticker_text_cannot_inject(curated):
    assert serving.price_filter(curated, "FPT' OR '1'='1").count() == 0


@pytest.mark.parametrize("page, limit", [(0, 10), (1, 0), (1, 1001)])
def test_page_bounds(curated, page, limit):
    with pytest.raises(ValueError):
        serving.prices_page(curated, "FPT", page=page, limit=limit)
    with pytest.raises(ValueError):
        serving.price_filter(curated, "FPT", "2025-02-01", "2025-01-01")


def test_filters_reach_the_scan(curated):
    rows = serving.price_filter(curated, "FPT", "2025-01-02").select("close_price")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "ticker" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "trading_date" in scan.split("PushedFilters:")[1]
    assert "open_price" not in scan.split("ReadSchema:")[1]


def test_empty_layer(spark, curated, universe):
    none = curated.filter("false")
    assert serving.companies(none, universe).count() == 0
    assert serving.prices_page(none, "FPT").total.first()[0] == 0


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_export_round_trip(spark, curated, tmp_path, form):
    path = str(tmp_path / "out")
    write_export(price_export(curated, "fpt", form), path, form)
    reader = spark.read.schema(curated.schema)
    rows = reader.option("header", True).csv(f"{path}/data") if form == "csv" else reader.parquet(f"{path}/data")
    assert sorted(r["close_price"] for r in rows.collect()) == [11.0, 12.0, 13.0, 14.0, 15.0, 15.0, 16.0, 17.0]
    manifest = spark.read.json(f"{path}/manifest").first()
    assert (manifest["ticker"], manifest["row_count"], manifest["format"]) == ("FPT", 8, form)
    assert manifest["columns"] == curated.columns
    assert price_export(curated, "NONE").manifest.count() == 0
    with pytest.raises(ValueError):
        write_export(price_export(curated, "FPT"), path, "xml")


def test_report_has_a_byte_order_mark_and_the_universe_reader_drops_it(spark, tmp_path):
    rows = spark.createDataFrame(
        [(f"t{i}", f"Công ty {i}", "HOSE", "S", "v1", "2026-07-19") for i in range(50)],
        "ticker string, name string, market string, sector string, version string, effective_date string",
    ).repartitionByRange(3, "ticker").sortWithinPartitions("ticker")
    write_report(rows, str(tmp_path / "u"))
    files = list((tmp_path / "u").glob("*.csv"))
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbfticker,") for f in files)
    universe = read_universe(spark, str(tmp_path / "u"))
    assert universe.count() == 50
    want = sorted(f"T{i}" for i in range(50))[:7]
    assert [r[0] for r in first_tickers(in_file_order(universe), 7).collect()] == want
