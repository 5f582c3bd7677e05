from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import curate
from ledgerline.operators.indicators import indicators
from ledgerline.operators.series import Layout
from ledgerline.schemas import CURATED_COLUMNS
from ledgerline.sources.raw import read_entries
from ledgerline.streaming.incremental import Online, indicator_batch, read_indicators
from ledgerline.streaming import versions
from ledgerline.streaming.jobs import (
    curate_batch,
    curated_stream_job,
    curated_tables,
    ledger_stream_job,
    ledger_table,
    raw_stream,
    read_curated_stream,
)


def line(ticker, day, close, status="PASS", code="OK"):
    record = {
        "ticker": ticker, "trading_date": f"2025-{1 + day // 28:02d}-{1 + day % 28:02d}", "open_price": 1.0, "high_price": 999.0,
        "low_price": 0.5, "close_price": close, "volume": 10,
    }
    meta = {"ticker": ticker, "status": status, "error_code": code, "completed_at": f"2025-01-{1 + day % 28:02d}T00:00:00Z"}
    return json.dumps({"metadata": meta, "records": [record] if status == "PASS" else []})


def put(root, name, lines):
    path = root / "year=2025" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def rows(df):
    return sorted(tuple(r) for r in df.select(*CURATED_COLUMNS).collect())


@pytest.fixture
def landed(tmp_path):
    raw = tmp_path / "raw"
    put(raw, "a.json", [line("AAA", d, 10.0 + d % 5) for d in range(30)])
    put(raw, "b.json", [line("BBB", d, 20.0 + d % 3) for d in range(20)])
    return raw


def batch_result(spark, raw):
    return indicators(curate.unique_bars(read_entries(spark, [str(raw)])))


def test_stream_equals_batch_over_several_micro_batches(spark, landed, tmp_path):
    out = str(tmp_path / "out")
    curated_stream_job(spark, str(landed), out, files_per_batch=1)
    assert rows(read_curated_stream(spark, out)) == rows(batch_result(spark, landed))
    # A late correction inside the history of one ticker, and a new ticker.
    put(landed, "c.json", [line("AAA", 3, 50.0), line("CCC", 1, 5.0)])
    curated_stream_job(spark, str(landed), out, files_per_batch=1)
    assert rows(read_curated_stream(spark, out)) == rows(batch_result(spark, landed))
    # What was not touched is not written again.
    written = versions.part(spark, curated_tables(out).rows, 2).filter("not is_old").select("ticker", F.month("trading_date"))
    assert {tuple(r) for r in written.collect()} == {("AAA", 1), ("AAA", 2), ("CCC", 1)}


def test_replaying_a_batch_changes_nothing(spark, landed, tmp_path):
    out = str(tmp_path / "out")
    lines = raw_lines(spark, landed)
    curate_batch(spark, lines, 0, out)
    first = rows(read_curated_stream(spark, out))
    curate_batch(spark, lines, 0, out)
    assert rows(read_curated_stream(spark, out)) == first


def test_layouts_lose_nothing_in_silence(spark, tmp_path):
    """An indented array, a single object and a file with a byte order mark."""
    raw = tmp_path / "raw"
    values = [json.loads(line("AAA", d, 10.0 + d)) for d in range(6)]
    put(raw, "array.json", [json.dumps(values[:3], indent=2)])
    put(raw, "single.json", [json.dumps(values[3], indent=2)])
    put(raw, "mark.json", ["\ufeff" + json.dumps(values[4:])])
    out = str(tmp_path / "whole")
    curated_stream_job(spark, str(raw), out, layout="array")
    assert [r["close_price"] for r in read_curated_stream(spark, out).orderBy("trading_date").collect()] == [10.0 + d for d in range(6)]
    assert spark.read.parquet(f"{out}/rejected").count() == 0
    ledger = ledger_stream_job(spark, str(raw), str(tmp_path / "ledger"), layout="array")
    assert [tuple(r) for r in ledger.collect()] == [("AAA", 6, 0, "OK")]
    # Read line by line, the two indented files are reported.
    lines = str(tmp_path / "lines")
    curated_stream_job(spark, str(raw), lines)
    assert {r["file_path"].rsplit("/", 1)[1] for r in spark.read.parquet(f"{lines}/rejected").collect()} == {"array.json", "single.json"}
    assert read_curated_stream(spark, lines).count() == 2


def raw_lines(spark, root):
    assert raw_stream(spark, str(root)).isStreaming
    return (
        spark.read.schema("value string").format("text").option("recursiveFileLookup", True).load(str(root))
        .select("value", F.col("_metadata.file_path"), F.lit(0).alias("root"), F.col("_metadata.file_block_start").alias("split_start"))
    )


def test_ledger_counts_across_micro_batches(spark, tmp_path):
    raw = tmp_path / "raw"
    put(raw, "a.json", [line("AAA", 1, 5.0), line("BBB", 1, 0, "FAIL", "RATE_LIMIT")])
    put(raw, "b.json", [line("BBB", 2, 0, "FAIL", "NO_DATA"), line("BBB", 3, 7.0)])
    got = ledger_stream_job(spark, str(raw), str(tmp_path / "out"), files_per_batch=1)
    assert {tuple(r) for r in got.collect()} == {("AAA", 1, 0, "OK"), ("BBB", 1, 2, "NO_DATA")}


def ticks(spark, start, stop, ticker="T"):
    return spark.range(start, stop, 1, 3).select(
        F.lit(ticker).alias("ticker"),
        F.timestamp_seconds(F.col("id") * 7000).cast("timestamp_ntz").alias("trading_date"),
        (F.lit(50.0) + F.pmod(F.col("id") * 37, F.lit(23)) - F.col("id") % 7).cast("double").alias("close_price"),
    )


def test_online_indicators_continue_and_go_back_for_late_bars(spark, tmp_path):
    layout = Layout(grain="day")
    out = str(tmp_path / "online")
    # Cuts of one bar, fewer bars than the tail, and across a block boundary.
    cuts = [0, 1, 2, 9, 40, 1500, 2100]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = ticks(spark, a, b)
        if n == 4:
            # Repeated bars of the first batches, and a ticker whose middle comes later.
            batch = batch.unionByName(ticks(spark, 5, 8)).unionByName(ticks(spark, 0, 10, "U"))
            batch = batch.unionByName(ticks(spark, 20, 30, "U"))
        if n == 5:
            batch = batch.unionByName(ticks(spark, 10, 20, "U"))
            indicator_batch(spark, batch, n, out, layout)  # replayed below
        indicator_batch(spark, batch, n, out, layout)
    whole = ticks(spark, 0, 2100).unionByName(ticks(spark, 0, 30, "U"))
    got = {tuple(r) for r in read_indicators(spark, out).collect()}
    want = {tuple(r) for r in indicators(whole, layout=Layout(grain="day")).collect()}
    assert len(got) == 2130 and got == want
    states = versions.part(spark, Online(out).current, 3)
    assert [r["ticker"] for r in states.collect()] == ["T"]


def closes(spark, *days):
    rows = [("T", f"2025-01-{d:02d} 00:00:00", float(c)) for d, c in days]
    return spark.createDataFrame(rows, "ticker string, at string, close_price double").select(
        "ticker", F.col("at").cast("timestamp_ntz").alias("trading_date"), "close_price"
    )


def test_late_and_corrected_bars_change_what_follows(spark, tmp_path):
    out = str(tmp_path / "online")
    indicator_batch(spark, closes(spark, (1, 10), (3, 12)), 0, out)
    indicator_batch(spark, closes(spark, (2, 11), (3, 13), (4, 14)), 1, out)
    got = {r["trading_date"].day: (r["close_price"], r["return_pct"]) for r in read_indicators(spark, out).collect()}
    assert got == {1: (10.0, None), 2: (11.0, 10.0), 3: (13.0, 18.1818), 4: (14.0, 7.6923)}
    # The state after batch 0 has been overtaken: going back to day 4 must not use it.
    indicator_batch(spark, closes(spark, (5, 7)), 2, out)
    indicator_batch(spark, closes(spark, (4, 26)), 3, out)
    got = {r["trading_date"].day: r["return_pct"] for r in read_indicators(spark, out).collect()}
    assert got == {1: None, 2: 10.0, 3: 18.1818, 4: 100.0, 5: -73.0769}


def test_a_batch_in_order_reads_no_history(spark, tmp_path, monkeypatch):
    """Bars and month states of earlier batches are read for late bars only."""
    out, read = str(tmp_path / "online"), []
    plain = versions.newest
    monkeypatch.setattr(
        "ledgerline.streaming.incremental.newest",
        lambda spark, table, *a, **k: read.append(table.root.rsplit("/", 1)[1]) or plain(spark, table, *a, **k),
    )
    indicator_batch(spark, ticks(spark, 0, 400), 0, out)
    indicator_batch(spark, ticks(spark, 400, 800), 1, out)
    assert read == ["current", "current"]
    indicator_batch(spark, ticks(spark, 600, 601), 2, out)
    assert sorted(read[2:]) == ["bars", "current", "periods"]
    recomputed = versions.part(spark, Online(out).rows, 2).filter("not is_old").count()
    # From the day of the late bar on: 799 - 600 rows and what its day had before.
    assert 200 <= recomputed <= 215
    got = {tuple(r) for r in read_indicators(spark, out).collect()}
    assert got == {tuple(r) for r in indicators(ticks(spark, 0, 800), layout=Layout(grain="day")).collect()}


def test_parts_are_merged_by_level_and_overtaken_rows_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FAN_IN", 3)
    table = versions.Versioned(str(tmp_path / "t"), "k int, v int", ("k",))
    want = {}
    for batch in range(11):
        versions.compact(spark, table, batch)
        rows = [(batch % 4, batch), (100 + batch, batch)]
        want.update(rows)
        for _ in range(2):  # replayed
            versions.add(table, spark.createDataFrame(rows, "k int, v int"), batch)
        assert {tuple(r) for r in versions.newest(spark, table).collect()} == set(want.items())
    assert versions.parts(spark, table) == [(0, 8), (9, 9), (10, 10)]
    assert len(list((tmp_path / "t").iterdir())) == 3
    before = versions.newest(spark, table, before=9)
    assert before.count() == 4 + 9 and before.filter("k = 3").first()["v"] == 7
    # A merge that broke off is not read.
    (tmp_path / "t" / "0000000000-0000000008" / "_SUCCESS").unlink()
    assert versions.parts(spark, table) == [(9, 9), (10, 10)]


def test_ledger_batches_write_what_they_change(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    put(raw, "a.json", [line(t, 1, 5.0) for t in ("AAA", "BBB", "CCC")])
    ledger_stream_job(spark, str(raw), out)
    put(raw, "b.json", [line("BBB", 2, 0, "FAIL", "NO_DATA")])
    got = ledger_stream_job(spark, str(raw), out)
    assert {tuple(r) for r in got.collect()} == {("AAA", 1, 0, "OK"), ("BBB", 1, 1, "NO_DATA"), ("CCC", 1, 0, "OK")}
    changed = versions.every_version(spark, ledger_table(out)).groupBy("batch_id").count().filter("count > 0")
    assert {tuple(r) for r in changed.collect()} == {(0, 3), (1, 1)}
