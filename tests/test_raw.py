from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import curate, quality
from ledgerline.operators.ingest import ingest
from ledgerline.sinks.curated import read_positions
from ledgerline.sinks.raw import write_payloads
from ledgerline.sources.curated import inventory, read_curated, stored_files
from ledgerline.sources.raw import LINEAGE, raw_records, read_entries, unreadable_files


def record(ticker="FPT", date="2025-01-02", close=11.0, **changes):
    base = {
        "ticker": ticker,
        "trading_date": date,
        "open_price": 10.0,
        "high_price": 12.0,
        "low_price": 9.0,
        "close_price": close,
        "volume": 1000,
    }
    return {k: v for k, v in {**base, **changes}.items() if v != "ABSENT"}


def payload(records, status="PASS", code="OK", ticker="FPT"):
    meta = {"provider": "FEED", "ticker": ticker, "status": status, "error_code": code, "rows": len(records), "attempts": 1}
    return {"metadata": meta, "records": records}


def put(path, content, bom=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = content if isinstance(content, str) else json.dumps(content, indent=2)
    path.write_text(text, encoding="utf-8-sig" if bom else "utf-8")


def bars_of(spark, *roots, layouts="array", **options):
    entries = read_entries(spark, [str(r) for r in roots], layouts)
    rows = curate.unique_bars(entries, **options).orderBy("ticker", "trading_date").collect()
    return [(r["ticker"], str(r["trading_date"]), r["close_price"]) for r in rows]


def test_array_object_and_byte_order_mark(spark, tmp_path):
    put(tmp_path / "year=2025/a.json", [payload([record(close=1.5)])], bom=True)
    put(tmp_path / "year=2025/b.json", payload([record(ticker="VCB", close=2.5)]))
    put(tmp_path / "year=2025/skip.txt", "not json")
    assert bars_of(spark, tmp_path) == [
        ("FPT", "2025-01-02 00:00:00", 1.5),
        ("VCB", "2025-01-02 00:00:00", 2.5),
    ]


def test_failed_payload_is_skipped_and_last_duplicate_wins(spark, tmp_path):
    put(tmp_path / "a.json", [payload([record(close=11)]), payload([], "FAIL", "NO_DATA", "VCB")])
    put(tmp_path / "b.json", [payload([record(close=12)])])
    assert bars_of(spark, tmp_path) == [("FPT", "2025-01-02 00:00:00", 12.0)]


def test_duplicates_inside_one_file_follow_entry_and_record_order(spark, tmp_path):
    put(tmp_path / "a.json", [payload([record(close=1), record(close=2)]), payload([record(close=3), record(close=4)])])
    assert bars_of(spark, tmp_path)[0][2] == 4.0


def test_files_are_read_in_component_order(spark, tmp_path):
    # As plain text "d-x/.." sorts before "d/..", by components it comes after.
    put(tmp_path / "d" / "z.json", [payload([record(close=1)])])
    put(tmp_path / "d-x" / "a.json", [payload([record(close=2)])])
    assert bars_of(spark, tmp_path)[0][2] == 2.0


def test_later_root_wins_and_missing_root_is_skipped(spark, tmp_path):
    put(tmp_path / "raw" / "z.json", [payload([record(close=1)])])
    put(tmp_path / "seed" / "a.json", [payload([record(close=2)])])
    raw, seed, absent = tmp_path / "raw", tmp_path / "seed", tmp_path / "absent"
    assert bars_of(spark, raw, absent, seed)[0][2] == 2.0
    assert bars_of(spark, seed, raw)[0][2] == 1.0
    with pytest.raises(FileNotFoundError):
        read_entries(spark, [str(absent)])


def test_a_file_under_two_roots_is_read_once(spark, tmp_path):
    put(tmp_path / "raw" / "z.json", [payload([record(close=1)])])
    entries = read_entries(spark, [str(tmp_path / "raw"), str(tmp_path), str(tmp_path / "raw")], "array")
    assert entries.count() == 1


def test_missing_metadata_counts_as_passed(spark, tmp_path):
    put(tmp_path / "a.json", {"records": [record(close=3)]})
    put(tmp_path / "b.json", [{"metadata": {"status": "PASS"}, "records": []}])
    assert bars_of(spark, tmp_path)[0][2] == 3.0


def test_lenient_numbers_and_zones(spark, tmp_path):
    put(
        tmp_path / "a.json",
        [payload([
            record(open_price="10", volume=1000.0, date="2025-01-02T00:00:00+07:00"),
            record(date="2025-01-03T10:00:00Z", volume="7"),
            record(date=1735948800),
        ])],
    )
    assert [b[1] for b in bars_of(spark, tmp_path)] == [
        "2025-01-01 17:00:00",
        "2025-01-03 10:00:00",
        "2025-01-04 00:00:00",
    ]


BAD = [
    ({"close_price": "ABSENT"}, "missing:close_price"),
    ({"trading_date": None}, "missing:trading_date"),
    ({"trading_date": "soon"}, "malformed:trading_date"),
    ({"open_price": 0}, "not_positive:open_price"),
    ({"low_price": -1}, "not_positive:low_price"),
    ({"close_price": "abc"}, "malformed:close_price"),
    ({"close_price": "Infinity"}, "malformed:close_price"),
    ({"volume": -1}, "negative:volume"),
    ({"volume": 1000.5}, "malformed:volume"),
    ({"high_price": 8.0}, "high_below_low"),
    ({"ticker": ""}, "length:ticker"),
    ({"ticker": "X" * 21}, "length:ticker"),
]


def test_each_rule_names_what_it_found(spark, tmp_path):
    for n, (change, _) in enumerate(BAD):
        put(tmp_path / f"{n:02d}.json", [payload([record(), record(**change)])])
    put(tmp_path / "zz.json", [payload([record()])])
    rejected = quality.rejected_batches(read_entries(spark, [str(tmp_path)], "array"))
    found = {r["file_path"].split("/")[-1][:2]: r for r in rejected.collect()}
    assert len(found) == len(BAD)
    for n, (_, rule) in enumerate(BAD):
        assert found[f"{n:02d}"]["violations"] == [rule]
        assert found[f"{n:02d}"]["gate_code"] == "BAD_DATA"
        assert found[f"{n:02d}"]["bad_records"] == 1


def test_one_bad_record_drops_its_batch_or_aborts(spark, tmp_path):
    put(tmp_path / "a.json", [payload([record(), record(date="2025-01-03", volume=-1)]), payload([record(ticker="VCB")])])
    assert [b[0] for b in bars_of(spark, tmp_path)] == ["VCB"]
    with pytest.raises(Exception, match="invalid record"):
        bars_of(spark, tmp_path, fail_fast=True)


def test_unreadable_file_is_reported(spark, tmp_path):
    put(tmp_path / "a.json", "{ this is not json")
    put(tmp_path / "b.json", [payload([record()])])
    entries = read_entries(spark, [str(tmp_path)], "array")
    assert [b[0] for b in bars_of(spark, tmp_path)] == ["FPT"]
    codes = {r["gate_code"] for r in quality.rejected_batches(entries).collect()}
    assert codes == {"BAD_DATA"}
    with pytest.raises(Exception, match="invalid record"):
        bars_of(spark, tmp_path, fail_fast=True)


def test_appending_leaves_earlier_files_untouched(spark, tmp_path):
    root = tmp_path / "raw"
    rows = spark.createDataFrame(
        [("2025-01-02", {"ticker": "A", "status": "PASS"}, [record()])],
        "batch_date string, metadata struct<ticker:string,status:string>, records array<struct<ticker:string,trading_date:string,open_price:double,high_price:double,low_price:double,close_price:double,volume:bigint>>",
    ).withColumn("batch_date", F.to_date("batch_date"))
    write_payloads(rows, str(root))
    before = {p: p.read_bytes() for p in root.rglob("*.json")}
    assert before and all("year=2025/month=01/day=02" in str(p) for p in before)
    write_payloads(rows, str(root))
    after = {p: p.read_bytes() for p in root.rglob("*.json")}
    assert len(after) == 2 * len(before) and all(after[p] == b for p, b in before.items())
    assert raw_records(read_entries(spark, [str(root)])).count() == 2


def test_transform_replaces_only_its_tickers(spark, tmp_path):
    root = str(tmp_path / "curated")
    put(tmp_path / "one" / "a.json", [payload([record("001", close=1), record("VCB", close=2)])])
    put(tmp_path / "two" / "a.json", [payload([record("VCB", "2025-02-02", close=5)])])
    curate.transform(spark, read_entries(spark, [str(tmp_path / "one")], "array"), root)
    kept = [p.read_bytes() for p in (tmp_path / "curated" / "ticker=001").glob("*.parquet")]
    curate.transform(spark, read_entries(spark, [str(tmp_path / "two")], "array"), root)
    rows = read_curated(spark, root).orderBy("ticker").collect()
    assert [(r["ticker"], r["close_price"]) for r in rows] == [("001", 1.0), ("VCB", 5.0)]
    assert kept == [p.read_bytes() for p in (tmp_path / "curated" / "ticker=001").glob("*.parquet")]
    assert tuple(inventory(stored_files(spark, root)).first()) == (2, True)
    assert {r["ticker"]: r["rows"] for r in read_positions(spark, root).collect()} == {"001": 1, "VCB": 1}


def test_transform_reports_what_it_wrote(spark, tmp_path):
    put(tmp_path / "raw" / "a.json", [payload([record("AAA"), record("AAA", "2025-02-02"), record("BBB")])])
    put(tmp_path / "raw" / "b.json", [payload([], "FAIL")])
    said = curate.transform(spark, read_entries(spark, [str(tmp_path / "raw")], "array"), str(tmp_path / "out")).first()
    assert said.asDict() == {"input_files": 2, "output_files": 2, "rows": 3, "tickers": 2}


def test_tickers_keep_their_names_in_the_inventory(spark, tmp_path):
    rows = spark.createDataFrame([("A+B", 1), ("C_D", 2), ("E%F", 3)], "ticker string, v int")
    rows.write.partitionBy("ticker").parquet(str(tmp_path / "t"))
    assert {r["ticker"] for r in stored_files(spark, str(tmp_path / "t")).collect()} == {"A+B", "C_D", "E%F"}


TRICKY_TEXTS = ['a "quoted" }{ brace', "back\\slash \\\" }", "}}}", '\\', "tab\t{\u00e9}[", ""]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_one_array_is_read_by_many_tasks(spark, tmp_path, indent, split):
    """Braces and quotes in texts, a byte order mark, and splits in the middle of anything."""
    values = [payload([record("AAA", f"2025-01-{d + 1:02d}", close=10 + d)] * 2, "PASS") for d in range(12)]
    for n, v in enumerate(values):
        v["metadata"]["provider"] = TRICKY_TEXTS[n % len(TRICKY_TEXTS)]
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.json").write_text("\ufeff" + json.dumps(values[:8], indent=indent) + "\n", encoding="utf-8")
    (folder / "b.json").write_text(json.dumps(values[8], indent=indent), encoding="utf-8")
    (folder / "c.json").write_text(json.dumps(values[9:], indent=indent, ensure_ascii=False), encoding="utf-8")
    (folder / "d.json").write_text("no json at all", encoding="utf-8")
    (folder / "e.json").write_text(" \n", encoding="utf-8")
    (folder / "f.json").write_text(json.dumps(values[:2], indent=indent)[:-40], encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        entries = read_entries(spark, [str(folder)], "array")
        rows = entries.orderBy(LINEAGE).collect()
        good = [r for r in rows if not r["unreadable"] and "f.json" not in r["file_path"]]
        assert [r["metadata"]["provider"] for r in good] == [v["metadata"]["provider"] for v in values]
        assert [float(r["records"][1]["close_price"]) for r in good] == [10.0 + d for d in range(12)]
        assert all(len(r["records"]) == 2 for r in good)
        assert {r["file_path"].rsplit("/", 1)[1] for r in unreadable_files(entries).collect()} == {"d.json"}
        cut = [r for r in rows if "f.json" in r["file_path"]]
        assert [r["unreadable"] for r in cut] == [False, True]
        pieces = spark.read.option("lineSep", "}").text(str(folder / "a.json"))
        assert split == "128m" or pieces.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_failed_transform_leaves_the_curated_layer_alone(spark, tmp_path):
    root = tmp_path / "curated"
    put(tmp_path / "good" / "a.json", [payload([record()])])
    put(tmp_path / "empty" / "a.json", [payload([], "FAIL")])
    put(tmp_path / "bad" / "a.json", [payload([record(volume=-5)])])
    curate.transform(spark, read_entries(spark, [str(tmp_path / "good")], "array"), str(root))
    before = {p: p.read_bytes() for p in root.rglob("*.parquet")}
    with pytest.raises(FileNotFoundError):
        curate.transform(spark, read_entries(spark, [str(tmp_path / "empty")], "array"), str(root))
    with pytest.raises(Exception, match="invalid record"):
        curate.transform(spark, read_entries(spark, [str(tmp_path / "bad")], "array"), str(root), fail_fast=True)
    assert before == {p: p.read_bytes() for p in root.rglob("*.parquet")}


def test_ingest_lands_what_transform_reads(spark, tmp_path):
    requests = spark.createDataFrame(
        [(" fpt ", 1, 1, None), ("FPT", 2, 1, None), ("vcb", 3, 1, None), ("bad", 4, 1, None), ("lim", 5, 3, "Rate limit")],
        "ticker string, position int, attempts int, message string",
    ).withColumns({c: F.lit("2025-01-01T00:00:00Z") for c in ["requested_at", "completed_at"]})
    history = spark.createDataFrame(
        [(t, f"2025-01-{d:02d}", 10.0, h, 9.0, 10.0 + d, 100) for t, h in [("FPT", 12.0), ("BAD", 1.0), ("LIM", 12.0)] for d in (2, 3)],
        "ticker string, time string, open double, high double, low double, close double, volume bigint",
    )
    payloads = ingest(requests, history, "FEED")
    found = {r["metadata"]["ticker"]: (r["metadata"]["error_code"], r["metadata"]["rows"], len(r["records"])) for r in payloads.collect()}
    assert found == {"FPT": ("OK", 2, 2), "VCB": ("NO_DATA", 0, 0), "BAD": ("BAD_DATA", 0, 0), "LIM": ("RATE_LIMIT", 0, 0)}
    write_payloads(payloads.withColumn("batch_date", F.lit("2025-01-04").cast("date")), str(tmp_path / "raw"))
    assert [b[0] for b in bars_of(spark, tmp_path / "raw", layouts="lines")] == ["FPT", "FPT"]
    with pytest.raises(Exception, match="invalid ticker"):
        ingest(requests.withColumn("ticker", F.lit("A/../B")), history, "FEED").collect()
