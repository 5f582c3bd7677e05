"""Nearest neighbours by inner product with a vantage-point tree per shard.

Largest inner product becomes nearest distance by one more coordinate: with M the longest
vector of a shard, x gets sqrt(M**2 - |x|**2) and a query gets 0. In that space the triangle
inequality holds and a branch is left out when ``factor`` times its least possible distance
exceeds the distance of the k-th best found so far. Factor 1 is exact search; a larger factor
leaves out more and may miss neighbours. A first walk with fast products finds the k-th best
score, from a bound that each query's own leaf gives. A second one takes every point that reaches it within rounding and orders them by products
added in order and then by id: of any number of distinct vectors that tie the smallest ids are kept.

Equal vectors are one point of the tree with the smallest ids that have it: no query can need
more than k + 1 of them, so a vector that a third of all rows share costs as much as one.
Shards hold a bounded number of points; queries meet them in blocks.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows without an id. Only vectors of one dimension are compared. Repeated ids are rows of their
own: a query leaves out its own row alone. Ties go to the smaller id. An empty table gives an
empty result. Columns beside vec_id and embedding may have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import stored, table

K = 20
QUERY_STEP = 20
# One restores exact search; measured recall of other factors is in the README.
FACTOR = 1.0
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
LEAF = 96
# A branch with less than this share of its rows in one half is a leaf: where most distances
# are equal, halving would go as deep as there are rows.
LEAST_SHARE = 1 / 16
# Pairs of the second walk that wait for their exact products, and components multiplied at one time.
WAITING_PAIRS = 1 << 20
PAIR_VALUES = 1 << 20


class Tree:
    """A vantage-point tree over the rows of a matrix.

    A branch is a tuple: vantage point, the distance that halves its rows, the distances the
    inner and the outer half lie between, and the two halves. A leaf is an array of rows.
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, root=None):
        self.vectors = vectors
        square = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(square.max())
        self.lift = np.sqrt(np.maximum(self.top - square, 0.0))
        self.leaf = leaf
        self.root = self._grow(np.arange(len(vectors)), np.random.default_rng(7)) if root is None else root

    def _between(self, one: int, rows: np.ndarray) -> np.ndarray:
        gap = self.vectors[rows] - self.vectors[one]
        lift = self.lift[rows] - self.lift[one]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + lift * lift)

    def _grow(self, rows: np.ndarray, draw):
        if len(rows) <= self.leaf:
            return rows
        # Of a few candidates the point whose distances spread most.
        picks = draw.choice(rows, min(5, len(rows)), replace=False)
        one = max(picks, key=lambda p: self._between(p, rows).std())
        away = self._between(one, rows)
        cut = float(np.median(away))
        inside = away <= cut
        if inside.all():
            inside = away < cut
        if min(inside.sum(), (~inside).sum()) < LEAST_SHARE * len(rows):
            return rows
        return (
            self.vectors[one],
            cut,
            (float(away[inside].min()), float(away[inside].max())),
            (float(away[~inside].min()), float(away[~inside].max())),
            self._grow(rows[inside], draw),
            self._grow(rows[~inside], draw),
        )

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and inner products of the k best per query, ties to the smaller row; -1 where there are fewer."""
        found = _Found(queries, self, k)
        every = np.arange(len(queries))
        self._descend(self.root, queries, every, found)
        best = _Best(queries, self.vectors, found)
        found.start_again()
        self._visit(self.root, queries, every, found, factor)
        best.add(*found.pairs())
        self._collect(self.root, queries, every, found, best, factor)
        return best.lists(k)

    def _visit(self, node, queries: np.ndarray, some: np.ndarray, found: _Found, factor: float) -> None:
        if not len(some):
            return
        if isinstance(node, np.ndarray):
            for at in range(0, len(node), self.leaf):
                rows = node[at : at + self.leaf]
                found.offer(some, rows, queries[some] @ self.vectors[rows].T)
            return
        for branch, mine in self._open(node, queries, some, found, factor):
            # What the first branch found narrows the second.
            self._visit(branch, queries, mine(), found, factor)

    def _descend(self, node, queries: np.ndarray, some: np.ndarray, found: _Found) -> None:
        if not len(some):
            return
        if isinstance(node, np.ndarray):
            found.offer(some, node[: self.leaf], queries[some] @ self.vectors[node[: self.leaf]].T)
            return
        point, cut, _, _, near, far = node
        inside = found.away(queries, some, point) <= cut
        self._descend(near, queries, some[inside], found)
        self._descend(far, queries, some[~inside], found)

    def _open(self, node, queries: np.ndarray, some: np.ndarray, found: _Found, factor: float):
        """Both branches and which queries may still gain there."""
        point, _, inner, outer, near, far = node
        away = found.away(queries, some, point)
        for branch, bounds in ((near, inner), (far, outer)):
            least = np.maximum(np.maximum(away - bounds[1], bounds[0] - away), 0.0)
            yield branch, lambda: some[factor * least <= found.limit(some)]

    def _collect(self, node, queries: np.ndarray, some: np.ndarray, found: _Found, best: _Best, factor: float) -> None:
        if not len(some):
            return
        if isinstance(node, np.ndarray):
            least = (found.worst[some] - 2 * found.blur[some])[:, None]
            for at in range(0, len(node), self.leaf):
                rows = node[at : at + self.leaf]
                query, place = np.nonzero(queries[some] @ self.vectors[rows].T >= least)
                best.add(some[query], rows[place])
            return
        for branch, mine in self._open(node, queries, some, found, factor):
            self._collect(branch, queries, mine(), found, best, factor)


class _Found:
    """Some k best rows of each query by fast products: what the k-th best score is."""

    def __init__(self, queries: np.ndarray, tree: Tree, k: int):
        square = np.einsum("ij,ij->i", queries, queries)
        self.base = square + tree.top
        # Bounds of the rounding of a product and of a distance.
        step = 4 * (queries.shape[1] + 4) * np.finfo(np.float64).eps
        self.blur = step * np.sqrt(square * tree.top)
        self.slack = 2 * np.sqrt(step * self.base)
        self.floor = np.full(len(queries), -np.inf)
        self._clear(len(queries), k)

    def _clear(self, queries: int, k: int) -> None:
        self.rows = np.full((queries, k), -1, dtype=np.int64)
        self.scores = np.full((queries, k), -np.inf)
        self.worst = self.floor.copy()

    def start_again(self) -> None:
        """Nothing is held, but what was the k-th best score stays a bound."""
        self.floor = self.worst - 2 * self.blur
        self._clear(*self.rows.shape)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        query, place = np.nonzero(self.rows >= 0)
        return query, self.rows[query, place]

    def away(self, queries: np.ndarray, some: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.base[some] - 2.0 * (queries[some] @ point), 0.0))

    def limit(self, some: np.ndarray) -> np.ndarray:
        """Distance of the k-th best found, and what rounding may add."""
        return np.sqrt(np.maximum(self.base[some] - 2.0 * self.worst[some], 0.0)) * (1 + 1e-9) + self.slack[some]

    def offer(self, some: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        better = scores.max(axis=1) > self.worst[some]
        some, scores = some[better], scores[better]
        if not len(some):
            return
        every = np.concatenate([self.scores[some], scores], axis=1)
        names = np.concatenate([self.rows[some], np.broadcast_to(rows, (len(some), len(rows)))], axis=1)
        k = self.scores.shape[1]
        best = np.argpartition(-every, k - 1, axis=1)[:, :k]
        self.scores[some] = np.take_along_axis(every, best, axis=1)
        self.rows[some] = np.take_along_axis(names, best, axis=1)
        self.worst[some] = np.maximum(self.scores[some].min(axis=1), self.floor[some])


class _Best:
    """The best rows of each query, by exact product and then by row, of all that are added.

    What was found before is among them: with a factor above 1 the second walk may not meet it.
    """

    def __init__(self, queries: np.ndarray, vectors: np.ndarray, found: _Found):
        self.queries, self.vectors, self.k = queries, vectors, found.rows.shape[1]
        self.query, self.row = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)
        self.waiting, self.held = [found.pairs()], found.rows.size

    def add(self, query: np.ndarray, row: np.ndarray) -> None:
        self.waiting.append((query, row))
        self.held += len(query)
        if self.held >= WAITING_PAIRS:
            self._settle()

    def _settle(self) -> None:
        query, row = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.held = [], 0
        step = max(1, PAIR_VALUES // self.vectors.shape[1])
        score = np.empty(len(query))
        for at in range(0, len(query), step):
            score[at : at + step] = exact_products(self.queries[query[at : at + step]], self.vectors[row[at : at + step]])
        query, row = np.concatenate([self.query, query]), np.concatenate([self.row, row])
        score = np.concatenate([self.score, score])
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        fresh = np.ones(len(query), dtype=bool)
        fresh[1:] = (query[1:] != query[:-1]) | (row[1:] != row[:-1])
        query, row, score = query[fresh], row[fresh], score[fresh]
        top = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.query, self.row, self.score = query[top], row[top], score[top]

    def lists(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            self._settle()
        rows = np.full((len(self.queries), k), -1, dtype=np.int64)
        scores = np.full((len(self.queries), k), -np.inf)
        place = np.arange(len(self.query)) - np.searchsorted(self.query, self.query)
        rows[self.query, place], scores[self.query, place] = self.row, self.score
        return rows, scores


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added in order of the components."""
    total = np.zeros(len(left))
    for k in range(left.shape[1]):
        total += left[:, k] * right[:, k]
    return total


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .withColumn("row_no", F.monotonically_increasing_id())
        .filter(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    )


def build_trees(spark: SparkSession, rows: DataFrame, k: int, shard_rows: int) -> DataFrame:
    """One row per shard: dim, shard, the tree, and the ids of its points."""
    first = Window.partitionBy("v").orderBy("vec_id", "row_no")
    points = (
        rows.withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", "row_no"))).alias("ids"))
    )
    points = stored(spark, points, "points")
    shards = max(1, -(-points.count() // shard_rows))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda c: c.map(lambda x: (x[0]["vec_id"], x[0]["row_no"])))
        ids = [[(r["vec_id"], r["row_no"]) for r in x] for x in pdf["ids"]]
        tree = Tree(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        blob = pickle.dumps((tree.vectors, tree.root, ids))
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "tree": [blob]})

    dealt = points.withColumn("dim", F.size("v")).withColumn("shard", F.expr(f"cast(pmod(xxhash64(v), {shards}) as int)"))
    return stored(spark, dealt.groupBy("dim", "shard").applyInPandas(grow, "dim int, shard int, tree binary"), "trees")


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """One row per block: dim, block, and its queries."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        blob = pickle.dumps((pdf["vec_id"].to_numpy(), pdf["row_no"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(np.float64)))
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "queries": [blob]})

    dealt = queries.withColumn("dim", F.size("v")).withColumn("block", F.expr(f"cast(pmod(xxhash64(row_no), {blocks}) as int)"))
    return dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, queries binary")


def best_of_shard(tree: Tree, ids: list, queries: tuple, k: int, factor: float) -> list[np.ndarray]:
    """query id, query row, vec_id, row and score of a shard's k best rows for each query."""
    query_ids, query_rows, vectors = queries
    # Points lie in order of their smallest id. One more than k: the query's own row is left out.
    rows, scores = tree.search(vectors, min(k + 1, len(ids)), factor)
    query, place = np.nonzero(rows >= 0)
    point, score = rows[query, place], scores[query, place]
    copies = np.array([len(ids[p]) for p in point])
    flat = np.array([pair for p in point for pair in ids[p]], dtype=np.int64).reshape(-1, 2)
    query, score = np.repeat(query, copies), np.repeat(score, copies)
    other = flat[:, 1] != query_rows[query]
    query, score, flat = query[other], score[other], flat[other]
    order = np.lexsort((flat[:, 1], flat[:, 0], -score, query))
    query, score, flat = query[order], score[order], flat[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    top = rank < k
    return [query_ids[query[top]], query_rows[query[top]], flat[top, 0], flat[top, 1], score[top]]


def nearest(
    spark: SparkSession,
    vectors: DataFrame,
    is_query,
    k: int = K,
    factor: float = FACTOR,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query row.

    ``is_query`` is a condition on vec_id.
    """
    rows = stored(spark, valid_vectors(vectors, id_col, vector_col), "vectors")
    trees = build_trees(spark, rows, k, shard_rows)
    queries = rows.filter(is_query)
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    shards = trees.agg(F.max("shard")).first()[0] or 0
    met = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(
        query_blocks(queries, blocks).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards)))),
        ["dim", "shard", "block"],
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "query_row", "vec_id", "row_no", "score"]
        for batch in batches:
            for tree, block in zip(batch.column("tree"), batch.column("queries")):
                points, root, ids = pickle.loads(tree.as_py())
                columns = best_of_shard(Tree(points, root=root), ids, pickle.loads(block.as_py()), k, factor)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    best = met.select("tree", "queries").mapInArrow(
        search, "query_id long, query_row long, vec_id long, row_no long, score double"
    )
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row_no")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


SQL = f"""
WITH fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM fine q JOIN fine c ON q.vec_id % {QUERY_STEP} = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
