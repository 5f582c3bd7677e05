from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import vp_tree

SCHEMA = "vec_id long, embedding array<float>, label int, v string, dim string, rank string"


def brute(rows, k):
    out = {}
    for place, (q, x) in enumerate(rows):
        if q % 20:
            continue
        found = sorted((-sum(a * b for a, b in zip(x, y)), c) for at, (c, y) in enumerate(rows) if at != place and len(y) == len(x))
        out.setdefault(q, []).append([(c, -s) for s, c in found[:k]])
    return out


@pytest.mark.parametrize("shard_rows", [40, 1000])
def test_factor_one_is_exact(spark, shard_rows):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=12).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, x, 0, "", "", "") for i, x in rows], SCHEMA)
    got = vp_tree.nearest(spark, df, F.col("vec_id") % 20 == 0, k=7, shard_rows=shard_rows).collect()
    want = brute(rows, 7)
    for q, lists in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[1] for m in mine] == [c for c, _ in lists[0]]
        assert [m[2] for m in mine] == pytest.approx([s for _, s in lists[0]], rel=1e-12)


def test_ties_copies_and_invalid_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(20, [1.0, 2.0])] + [(100, [2.0, 1.0]), (101, [3.0])]
    bad = [(200, None), (220, [0.0, 0.0]), (240, [1.0, None]), (260, [nan, 1.0]), (280, [inf, 1.0]), (300, []), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(i, x, 0, "", "", "") for i, x in [*rows, *bad]], SCHEMA)
    got = vp_tree.nearest(spark, df, F.col("vec_id") % 20 == 0, k=5).collect()
    want = brute(rows, 5)
    assert {r["query_id"] for r in got} == set(want) == {0, 20, 40, 100}
    for q, lists in want.items():
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert sorted(c for _, c in mine) == sorted(c for one in lists for c, _ in one)


def test_fewer_candidates_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], 0, "", "", ""), (1, [2.0], 0, "", "", "")], SCHEMA)
    assert [tuple(r) for r in vp_tree.nearest(spark, df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 2.0)]
    assert vp_tree.nearest(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (1.1, 0.9)])
def test_recall(factor, least):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(30, 16))
    points = centres[draw.integers(0, 30, 4000)] + 0.3 * draw.normal(size=(4000, 16))
    queries = points[::40]
    _, scores = vp_tree.Tree(points).search(queries, 10, factor)
    want = -np.sort(-(queries @ points.T), axis=1)[:, 9]
    assert (scores >= want[:, None] - 1e-9).mean() >= least


def test_pruning_leaves_branches_out():
    draw = np.random.default_rng(7)
    points = draw.normal(size=(20, 3))[draw.integers(0, 20, 5000)] * 20 + draw.normal(size=(5000, 3)) * 0.01
    tree, seen = vp_tree.Tree(points), []
    offer = vp_tree._Found.offer
    vp_tree._Found.offer = lambda self, some, rows, scores: (seen.append(scores.size), offer(self, some, rows, scores))
    try:
        tree.search(points[::100], 5)
    finally:
        vp_tree._Found.offer = offer
    assert sum(seen) < 0.7 * 50 * 5000


@pytest.mark.parametrize("shard_rows", [60, 1000])
def test_distinct_vectors_that_tie_go_to_the_smaller_id(spark, shard_rows):
    """Signs with the same sum: every query meets far more than k distinct vectors of one score."""
    draw = np.random.default_rng(8)
    signs = {tuple(draw.permutation([1.0] * 6 + [-1.0] * 6).tolist()) for _ in range(600)}
    ids = draw.permutation(len(signs) + 1)
    rows = [(int(i), list(x)) for i, x in zip(ids, [*sorted(signs), (1.0,) * 12])]
    df = spark.createDataFrame([(i, x, 0, "", "", "") for i, x in rows], SCHEMA)
    got = vp_tree.nearest(spark, df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows).collect()
    for q, lists in brute(rows, 20).items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(c, s) for _, c, s in mine] == lists[0]


def test_many_equal_distances_do_not_deepen_the_tree():
    points = np.eye(2000)
    rows, scores = vp_tree.Tree(points).search(points[:3], 21)
    for i in range(3):
        assert rows[i].tolist() == [i, *[r for r in range(22) if r != i][:20]]
        assert scores[i].tolist() == [1.0] + [0.0] * 20
