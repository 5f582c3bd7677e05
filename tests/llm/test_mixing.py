from __future__ import annotations

import math
from collections import Counter

import pytest

from ledgerline.llm import mixing

DOCS = "doc_id long, text string, source string"


def targets_by_hand(sizes: dict, weights, most: int) -> dict:
    """Shares by weight; what exceeds a cap is shared anew by weight until none does."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(share[s]) if s in share else float(most * sizes[s]) for s in order}
        capped |= over


def texts(sizes_by_source):
    number, rows = 0, []
    for source, sizes in sizes_by_source.items():
        for size in sizes:
            rows.append((number, " ".join(["w"] * size), source))
            number += 1
    return rows


CASES = [
    {"a": [5, 9, 100, 3] * 20, "b": [7] * 100, "c": [1, 2, 400], "d": [50, 60] * 10},
    {"a": [1000] * 5, "b": [3], "c": [2]},  # small sources stop at three times their size
    {"ä": [10, 20], "z": [10, 20], None: [10, 20], "A": [0, 0, 7]},
    {"a": [0, 0], "b": [0]},
]


@pytest.mark.parametrize("case", CASES)
def test_targets_and_taken(spark, case):
    docs = spark.createDataFrame(texts(case), DOCS)
    rows = mixing.mix(spark, docs).collect()
    assert len(rows) == sum(map(len, case.values()))
    want = targets_by_hand({k: sum(v) for k, v in case.items()}, mixing.WEIGHTS, mixing.MOST)
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
        assert r["source_size"] == sum(case[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for source, sizes in case.items():
        least = min([s for s in sizes if s] or [0])
        assert abs(taken[source] - want[source]) <= max(1.0, least), source


def test_rates_are_exponential_in_size(spark):
    docs = spark.createDataFrame(texts({"a": [10, 20, 40] * 30, "b": [15] * 10}), DOCS)
    cells = mixing.sizes(docs).groupBy("source", "size").count().selectExpr("source c_source", "size", "count n")
    targets = mixing.source_targets(spark, cells.withColumnRenamed("c_source", "source"))
    tilts = {r["source"]: r for r in mixing.solve_tilts(spark, cells, targets).collect()}
    tilt = tilts["a"]["tilt"] / tilts["a"]["mean_size"]
    given = sum(30 * s * min(3.0, math.exp(tilt * s)) for s in (10, 20, 40))
    assert given == pytest.approx(tilts["a"]["target"], rel=1e-5)


def test_hot_size_is_shared_by_rank(spark):
    """One size holds nearly all documents of its source; copies still add up exactly."""
    docs = spark.createDataFrame(texts({"a": [8] * 2000, "b": [10] * 700}), DOCS)
    rows = mixing.mix(spark, docs).collect()
    for source in ("a", "b"):
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= mine[0]["size"] / 2 + 1e-6
        assert max(r["copies"] for r in mine) - min(r["copies"] for r in mine) <= 1


def test_odd_documents_and_reruns(spark, tricky, no_docs):
    one = sorted(map(str, mixing.mix(spark, tricky).collect()))
    assert one == sorted(map(str, mixing.mix(spark, tricky.repartition(5)).collect()))
    assert len(one) == tricky.count()
    copies = Counter()
    for r in mixing.mix(spark, tricky).collect():
        copies[r["doc_id"]] += r["copies"]
    mixed = mixing.mixed_documents(spark, tricky)
    assert mixed.columns == tricky.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies
    assert mixing.mix(spark, no_docs).count() == 0 and mixing.mixed_documents(spark, no_docs).count() == 0
