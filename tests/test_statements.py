from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import dataset, evaluation, labels, ratios
from ledgerline.operators import statements as st
from ledgerline.operators.quantiles import exact_quantiles, in_ranges, value_ranks
from ledgerline.operators.ratios import peer_rank

ITEMS = [
    "current_assets", "total_assets", "total_liabilities", "current_liabilities", "long_term_debt", "equity",
    "retained_earnings", "net_revenue", "interest_expense", "ebit", "net_profit", "operating_cash_flow", "market_cap",
]
# Two published sample companies, 2019 to 2024, in billions.
STATEMENTS = {
    "FPT": [
        [22500, 26800, 32400, 38200, 44500, 52100], [33300, 38700, 46500, 55800, 65800, 77900],
        [18100, 21400, 26200, 31500, 37100, 43800], [16800, 19900, 24500, 29600, 35200, 41500],
        [1300, 1500, 1700, 1900, 1900, 2300], [15200, 17300, 20300, 24300, 28700, 34100],
        [5400, 6200, 7600, 9400, 11800, 14600], [27717, 29830, 35657, 44010, 52618, 62800],
        [420, 480, 560, 690, 810, 950], [4686, 5263, 6337, 7652, 9203, 11100],
        [3912, 4424, 5349, 6491, 7788, 9350], [4150, 5200, 6100, 7400, 8900, 10600],
        [42000, 53000, 84000, 92000, 125000, 168000],
    ],
    "VNM": [
        [24700, 29500, 36100, 31200, 35800, 38900], [44600, 48400, 53300, 48400, 52700, 56400],
        [14900, 14800, 17400, 15600, 17600, 18900], [14600, 14400, 17000, 15300, 17300, 18500],
        [300, 400, 400, 300, 300, 400], [29700, 33600, 35900, 32800, 35100, 37500],
        [7800, 8900, 9200, 7900, 8500, 9100], [56318, 59636, 60919, 59956, 60479, 63100],
        [110, 150, 190, 280, 340, 310], [12796, 13519, 12922, 10496, 10968, 11800],
        [10554, 11236, 10632, 8578, 9019, 9650], [10200, 11400, 9800, 8900, 9500, 10100],
        [205000, 228000, 180000, 160000, 142000, 145000],
    ],
}
RATIOS = [
    "current_ratio", "working_capital_to_ta", "ocf_to_current_liabilities", "roa", "roe", "ebit_margin", "ebit_to_ta",
    "asset_turnover", "short_term_debt_to_ta", "long_term_debt_to_ta", "debt_to_ta", "log_total_assets", "market_equity_to_debt",
]
# Their published ratios, and growth of assets and profit from 2020 on.
EXPECTED = {
    "FPT": [
        [1.34, 0.17, 0.25, 11.75, 25.74, 16.91, 14.07, 0.83, 0.50, 0.04, 0.54, 4.52, 2.32],
        [1.35, 0.18, 0.26, 11.43, 25.57, 17.64, 13.60, 0.77, 0.51, 0.04, 0.55, 4.59, 2.48],
        [1.32, 0.17, 0.25, 11.50, 26.35, 17.77, 13.63, 0.77, 0.53, 0.04, 0.56, 4.67, 3.21],
        [1.29, 0.15, 0.25, 11.63, 26.71, 17.39, 13.71, 0.79, 0.53, 0.03, 0.56, 4.75, 2.92],
        [1.26, 0.14, 0.25, 11.84, 27.14, 17.49, 13.99, 0.80, 0.54, 0.03, 0.56, 4.82, 3.37],
        [1.26, 0.14, 0.26, 12.00, 27.42, 17.68, 14.25, 0.81, 0.53, 0.03, 0.56, 4.89, 3.84],
    ],
    "VNM": [
        [1.69, 0.23, 0.70, 23.66, 35.54, 22.72, 28.69, 1.26, 0.33, 0.01, 0.33, 4.65, 13.76],
        [2.05, 0.31, 0.79, 23.21, 33.44, 22.67, 27.93, 1.23, 0.30, 0.01, 0.31, 4.68, 15.41],
        [2.12, 0.36, 0.58, 19.95, 29.62, 21.21, 24.24, 1.14, 0.32, 0.01, 0.33, 4.73, 10.34],
        [2.04, 0.33, 0.58, 17.72, 26.15, 17.51, 21.69, 1.24, 0.32, 0.01, 0.32, 4.68, 10.26],
        [2.07, 0.35, 0.55, 17.11, 25.70, 18.14, 20.81, 1.15, 0.33, 0.01, 0.33, 4.72, 8.07],
        [2.10, 0.36, 0.55, 17.11, 25.73, 18.70, 20.92, 1.12, 0.33, 0.01, 0.34, 4.75, 7.67],
    ],
}
GROWTH = {
    "FPT": [(16.2, 13.1), (20.2, 20.9), (20.0, 21.4), (17.9, 20.0), (18.4, 20.1)],
    "VNM": [(8.5, 6.5), (10.1, -5.4), (-9.2, -19.3), (8.9, 5.1), (7.0, 7.0)],
}


@pytest.fixture(scope="module")
def statements(spark):
    rows = [
        (t, 2019 + y, *[float(values[y]) for values in items])
        for t, items in STATEMENTS.items()
        for y in range(6)
    ]
    return spark.createDataFrame(rows, "ticker string, year int, " + ", ".join(f"{i} double" for i in ITEMS))


def test_published_ratios(statements):
    got = {(r["ticker"], r["year"]): r for r in ratios.ratios(statements).collect()}
    for ticker, years in EXPECTED.items():
        for y, row in enumerate(years):
            for name, want in zip(RATIOS, row):
                assert got[ticker, 2019 + y][name] == pytest.approx(want, abs=0.0051), (ticker, y, name)
        for y, (assets, profit) in enumerate(GROWTH[ticker], 1):
            assert got[ticker, 2019 + y]["asset_growth"] == pytest.approx(assets, abs=0.051)
            assert got[ticker, 2019 + y]["profit_growth"] == pytest.approx(profit, abs=0.051)
        assert got[ticker, 2019]["asset_growth"] is None


def test_z_score_and_healthy_labels(statements):
    rows = {(r["ticker"], r["year"]): r for r in labels.distress_labels(statements).collect()}
    assert round(rows["VNM", 2024]["z_score"], 2) == 7.07
    assert {r["distress_label"] for r in rows.values()} == {0}
    assert rows["VNM", 2024]["distress_status"] == "SAFE"


def company(year, ticker="A", **changes):
    base = dict(zip(ITEMS, [float(v[5]) for v in STATEMENTS["VNM"]]))
    return {"ticker": ticker, "year": year, **base, **changes}


def frame(spark, rows):
    schema = "ticker string, year int, " + ", ".join(f"{i} double" for i in ITEMS)
    return spark.createDataFrame([tuple(r[c] for c in ["ticker", "year", *ITEMS]) for r in rows], schema)


def test_each_rule_fires_on_its_own(spark):
    rows = [
        company(2020, "R1", net_profit=-1.0), company(2021, "R1", net_profit=-1.0),
        company(2021, "R2", equity=-1.0), company(2021, "R3", retained_earnings=-1.0),
        company(2021, "R4", ebit=100.0), company(2021, "none", ebit=-1.0, interest_expense=0.0),
        company(2020, "R5", operating_cash_flow=-1.0), company(2021, "R5", operating_cash_flow=-1.0),
        company(2021, "R6", current_liabilities=99999.0),
        company(2019, "gap", net_profit=-1.0), company(2021, "gap", net_profit=-1.0),
    ]
    got = labels.with_rules(frame(spark, rows)).filter("year = 2021").collect()
    for r in got:
        fired = [code for code in labels.RULES if r[code]]
        assert fired == ([r["ticker"]] if r["ticker"] in labels.RULES else [])
        assert r["rules_fired"] == len(fired)


def test_missing_values_do_not_fire_or_score(spark):
    row = frame(spark, [company(2021, equity=None, net_profit=None, total_liabilities=None)])
    got = labels.distress_labels(row).first()
    assert (got["rules_fired"], got["z_score"], got["zone"], got["distress_label"]) == (0, None, None, 0)


def test_labelling_methods(spark):
    judged = labels.altman(labels.with_rules(frame(spark, [company(2021, equity=-1.0, retained_earnings=-1.0)])))
    got = judged.select(*[labels.label(m).alias(m) for m in labels.METHODS]).first()
    assert tuple(got) == (1, 0, 1)
    with pytest.raises(ValueError):
        labels.label("GUESS")


def test_quantiles_match_brute_force_with_hot_values(spark):
    rng = random.Random(4)
    data = {
        "ties": [1.0] * 4000 + [rng.gauss(0, 5) for _ in range(2000)],
        "wide": [rng.uniform(-1e6, 1e6) for _ in range(5000)],
        "few": [3.0, 1.0, 2.0],
        "one": [7.0],
    }
    rows = [(k, v) for k, values in data.items() for v in values] + [("few", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    # Few rows a range cut keys anywhere; the answer must not depend on it.
    for range_rows in (100, 100_000):
        got = exact_quantiles(df, ["k"], "v", probabilities, range_rows).collect()
        assert len(got) == len(data) * len(probabilities)
        for r in got:
            values = sorted(data[r["k"]])
            pos = r["p"] * (len(values) - 1)
            low = values[int(pos)]
            high = values[min(int(pos) + 1, len(values) - 1)]
            assert r["quantile"] == pytest.approx(low + (high - low) * (pos - int(pos)), rel=1e-12, abs=1e-9)


def test_value_ranks_match_brute_force(spark):
    rng = random.Random(5)
    data = {"hot": [float(rng.randint(0, 400)) for _ in range(6000)] + [50.0] * 3000, "b": [1.0, 1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    for range_rows in (20, 1000):
        for r in value_ranks(df, ["k"], "v", range_rows).collect():
            values = data[r["k"]]
            assert r["n_here"] == values.count(r["v"])
            assert r["n_before"] == sum(v < r["v"] for v in values)


def test_ranges_follow_the_number_of_values(spark):
    """One key holds nearly all rows: no range holds much more than was asked for."""
    counts = spark.range(20_000).selectExpr("if(id % 50 = 0, 'b', 'a') k", "cast(id as double) v", "1 n_here")
    sizes = [r["count"] for r in in_ranges(counts, ["k"], "v", 1000).groupBy("_bin").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000 and sum(sizes) == 20_000


def test_prices_are_carried_over_years_without_bars(spark):
    prices = spark.createDataFrame(
        [("A", 2018, 5.0, "2018-12-28"), ("A", 2021, 7.0, "2021-03-01"), ("B", 2021, 9.0, "2021-12-30")],
        "ticker string, year int, year_end_price double, priced_on string",
    )
    wanted = spark.createDataFrame(
        [("A", 2017), ("A", 2018), ("A", 2020), ("A", 2020), ("A", 2022), ("B", 2020), ("C", 2021)], "ticker string, year int"
    )
    got = {(r["ticker"], r["year"]): (r["year_end_price"], r["priced_on"]) for r in st.prices_as_of(prices, wanted).collect()}
    assert got == {
        ("A", 2017): (None, None), ("A", 2018): (5.0, "2018-12-28"), ("A", 2020): (5.0, "2018-12-28"),
        ("A", 2022): (7.0, "2021-03-01"), ("B", 2020): (None, None), ("C", 2021): (None, None),
    }


def test_peer_rank_matches_brute_force(spark):
    rng = random.Random(6)
    rows = [(f"T{i}", "big" if i % 10 else "small", 2020, round(rng.gauss(0, 2), 1)) for i in range(1000)]
    df = spark.createDataFrame(rows, "ticker string, industry string, year int, roa double")
    got = {r["ticker"]: r for r in peer_rank(df, "roa", ["industry", "year"]).collect()}
    assert len(got) == len(rows)
    for ticker, industry, _, roa in rows:
        peers = [r[3] for r in rows if r[1] == industry]
        below = sum(p < roa for p in peers)
        assert got[ticker]["percent_rank"] == pytest.approx(below / (len(peers) - 1), abs=1e-6)
        assert got[ticker]["peer_median"] == pytest.approx(statistics.median(peers), abs=1e-6)


def test_winsorize_clips_and_logs(spark):
    rows = [("A", i, float(i)) for i in range(101)] + [("A", 500, float("inf")), ("A", 501, None)]
    df = spark.createDataFrame(rows, "ticker string, year int, roa double")
    bounds = st.winsor_bounds(df, ["roa"], 5)
    assert bounds == {"roa": (5.0, 95.0)}
    treated = {r["year"]: r["roa"] for r in st.winsorize(df, bounds).collect()}
    assert (treated[0], treated[50], treated[100], treated[500], treated[501]) == (5.0, 50.0, 95.0, None, None)
    log = {r["year"]: r["action"] for r in st.outlier_log(df, bounds).collect()}
    assert log[0] == "RAISED_TO_LOW" and log[100] == "CUT_TO_HIGH" and log[500] == "SET_NULL"
    assert len(log) == 11 and st.winsor_bounds(df, ["roa"], 0) == {}


def test_history_needs_consecutive_years(spark):
    years = {"run": [2010, 2011, 2012, 2013, 2014], "gap": [2010, 2011, 2013, 2014, 2015], "twice": [2010, 2011]}
    df = spark.createDataFrame([(t, y) for t, ys in years.items() for y in ys + ys], "ticker string, year int")
    assert {r[0] for r in st.min_history(df, 5).select("ticker").collect()} == {"run"}
    assert tuple(st.qualification(df, 3).first()) == (3, 2, 1)


def test_units_and_aliases(spark):
    rows = spark.createDataFrame(
        [("  TOTAL assets ", "THOUSAND_VND", 2e6), ("OCF net", "BILLION_VND", 3.0), ("Mystery", "POINTS", 1.0)],
        "metric_name string, unit string, value double",
    )
    mapped = st.convert_units(st.map_metrics(rows, st.alias_table(spark)))
    got = {r["metric_name"].strip(): (r["standard_key"], r["unit"], r["value"]) for r in mapped.collect()}
    assert got["TOTAL assets"] == ("total_assets", "BILLION_VND", 2.0)
    assert got["OCF net"] == ("operating_cash_flow", "BILLION_VND", 3.0)
    assert got["Mystery"] == (None, None, None)
    extended = st.alias_table(spark, [(" Mystery ", "equity"), ("mystery", "equity"), ("", "equity")])
    assert extended.filter("alias = 'mystery'").count() == 1


def test_reports_round_trip(spark):
    rows = [("A", "YEARLY", "BS", "equity", "VND", str(y), float(y)) for y in (2019, 2020)]
    rows += [("A", "YEARLY", "CF", "operating_cash_flow", "VND", "2020", -5.0)]
    schema = "ticker string, period_type string, statement string, metric_code string, unit string, period string, value double"
    long = spark.createDataFrame(rows, schema)
    reports = st.to_reports(long)
    one = reports.first()
    assert one["periods"] == ["2019", "2020"] and one["income_statement"] == []
    assert one["balance_sheet"][0]["values"] == {"2019": 2019.0, "2020": 2020.0}
    back = st.from_reports(reports).select(*long.columns)
    assert back.exceptAll(long).count() == 0 and long.exceptAll(back).count() == 0


def test_reports_round_trip_with_names(spark):
    schema = (
        "ticker string, period_type string, statement string, metric_code string, metric_name string, unit string,"
        " category string, period string, value double"
    )
    rows = [("A", "YEARLY", "BS", "equity", "Equity", "VND", "Capital", str(y), float(y)) for y in (2019, 2020)]
    long = spark.createDataFrame(rows, schema)
    back = st.from_reports(st.to_reports(long)).select(*long.columns)
    assert back.exceptAll(long).count() == 0 and long.exceptAll(back).count() == 0
    # Two names of one code make one item.
    renamed = spark.createDataFrame([rows[0], (*rows[1][:4], "Own funds", *rows[1][5:])], schema)
    items = st.to_reports(renamed).first()["balance_sheet"]
    assert [(i["metric_name"], i["values"]) for i in items] == [("Equity", {"2019": 2019.0, "2020": 2020.0})]


def test_auc_matches_pair_counting(spark):
    rng = random.Random(8)
    rows = [("m", round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(2000)]
    points = evaluation.roc_points(spark.createDataFrame(rows, "model string, score double, y int"), ["model"], "score", "y")
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert evaluation.roc_auc(points, ["model"]).first()["auc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-6)


def test_metrics_without_a_class_are_null(spark):
    scored = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 0)], "k string, p double, y int")
    got = evaluation.class_metrics(evaluation.confusion_matrix(scored, ["k"], "p", "y")).first()
    assert (got["tn"], got["precision"], got["recall"], got["accuracy"]) == (2, None, None, 1.0)


def test_split_by_time_only(spark):
    rows = spark.createDataFrame([("A", y) for y in range(2016, 2026)], "ticker string, year int")
    train, test = dataset.time_split(rows, (2018, 2022), (2023, 2025))
    assert train.agg(F.min("year"), F.max("year")).first() == (2018, 2022)
    assert test.agg(F.min("year"), F.max("year")).first() == (2023, 2025)
    with pytest.raises(ValueError):
        dataset.time_split(rows, (2018, 2023), (2023, 2025))


def test_risk_levels_and_trend(spark):
    rows = spark.createDataFrame([("A", 2019, 5.8), ("A", 2020, 10.0), ("A", 2021, 50.1)], "ticker string, year int, probability_pct double")
    trend = dataset.risk_trend(rows).withColumn("level", dataset.risk_level(F.col("probability_pct"))).orderBy("year").collect()
    assert [r["level"] for r in trend] == ["LOW", "MODERATE", "HIGH"]
    assert [r["direction"] for r in trend] == [None, "up", "up"]
    assert [len(r["history"]) for r in trend] == [1, 2, 3]


def exchanges(frame) -> int:
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_reports_shuffle_no_items(spark):
    """Rows dealt by company become items and reports where they lie; duplicates of names aside, nothing is lost."""
    wide = spark.range(40).selectExpr(
        "concat('C', id % 20) ticker", "cast(id div 20 as string) period", "cast(id as double) equity", "cast(id * 2 as double) cogs"
    )
    dealt = st.by_company(wide, task_rows=7)
    assert dealt.rdd.getNumPartitions() == 6
    items = st.to_long(dealt, ["ticker", "period"], ["equity", "cogs"]).select(
        "ticker", F.lit("YEARLY").alias("period_type"), F.when(F.col("metric_code") == "equity", "BS").otherwise("IS").alias("statement"),
        "metric_code", F.lit("VND").alias("unit"), "period", "value",
    )
    reports = st.to_reports(items)
    assert exchanges(reports) == 1
    back = st.from_reports(reports).select(*items.columns)
    assert back.count() == 80 and back.exceptAll(items).count() == 0


def test_landed_reports_are_packed(spark, sf_dir):
    from ledgerline.plans import fundamentals

    files = fundamentals._landed_reports(spark, sf_dir).inputFiles()
    assert files and all(f.endswith(".json.gz") for f in files)


def test_wide_rows_need_one_aggregate(spark):
    long = spark.createDataFrame([("A", "x", 1.0), ("A", "x", 3.0), ("A", "y", None), ("B", "z", 2.0)], "t string, metric_code string, value double")
    wide = st.to_wide(long, ["t"], ["x", "y"])
    assert exchanges(wide) == 1
    assert sorted(map(tuple, wide.collect())) == [("A", 3.0, None), ("B", None, None)]


def test_statement_inputs_join_orders_not_lines(spark, tmp_path):
    """Lines are summed per order before the join; repeated orders count twice, null keys not at all."""
    from ledgerline.plans import inputs

    orders = [(1, 7, "1995-03-01"), (1, 7, "1995-03-01"), (2, 7, "1995-12-31"), (3, None, "1996-01-01"), (None, 7, "1995-01-01")]
    lines = [(1, 100.0, 0.1, 0.02, "R", "O"), (1, 50.0, 0.0, 0.04, None, "F"), (2, 10.0, 0.5, 0.0, "N", "O"), (None, 999.0, 0.0, 0.0, "N", "F"), (3, 5.0, 0.0, 0.0, "A", "F")]
    schema = "l_orderkey long, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    made = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "date(d) o_orderdate")
    made.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    frame = inputs.statements(spark, str(tmp_path))
    got = {(r["ticker"], r["year"]): r for r in frame.collect()}
    assert set(got) == {("C7", 1995), (None, 1996)}
    row = got["C7", 1995]
    assert (row["inventory"], row["net_revenue"], row["interest_expense"]) == (pytest.approx(31.0), 5.0, pytest.approx(4.0))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate [l_orderkey")


def test_dataset_stores_no_ratios(spark, sf_dir):
    """Its ratios are columns of a statement row: no layer beside the statements is written for it."""
    from ledgerline.plans import modelling

    read = {f.split("/")[-2].split("-")[0] for f in modelling._build_dataset(spark, sf_dir).inputFiles() if "ledgerline" in f}
    assert read == {"statements"}


def test_sparse_rows_are_counted_once(spark):
    wide = spark.createDataFrame([("A", 1, None), ("B", None, None), ("C", 1, 2)], "t string, x int, y int")
    gapped = wide.select("t", *[F.when(F.substring("t", 1, 1) != "Z", F.col(c)).alias(c) for c in "xy"])
    kept = st.drop_sparse(gapped, ["x", "y"])
    assert {r["t"]: r["missing_items"] for r in kept.collect()} == {"A": 1, "C": 0}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    # The condition is on the number, not on the items it was counted from.
    assert all("CASE" not in line for line in plan.splitlines() if "Filter" in line)


def test_peers_are_shuffled_by_value_only(spark):
    rows = spark.range(3000).selectExpr("concat('C', id) ticker", "cast(id % 3 as string) industry", "double(id % 11) roa")
    got = peer_rank(rows, "roa", ["industry"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(industry" not in plan
    found = got.groupBy("industry").agg(F.count("*").alias("n"), F.max("peers").alias("p")).collect()
    assert sorted((r["industry"], r["n"], r["p"]) for r in found) == [(str(i), 1000, 1000) for i in range(3)]
