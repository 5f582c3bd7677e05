"""Ranked lexical search: a document FP-tree searched by branch and bound.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, with A to Z
lower-cased. A first pass reads every text whole and keeps, of each document, its number of
terms and the frequencies of those terms that occur in some item (the restricted vector);
document counts and frequencies over all documents come from these rows.

Restricted vectors are ordered by document frequency, most frequent first, so documents share
beginnings, and are range-partitioned by them: neighbours in that order share the trie paths
of one task. A task cuts its rows into trees of at most TREE documents. A node stands for a
common beginning and knows, for its subtree, the largest frequency of every term and the
smallest document measure m; a small subtree is a leaf of at most LEAF documents. Per item the
tree is searched depth first, best child first: the score that the subtree's largest
frequencies would reach with its smallest m bounds all documents below, and what cannot come
up to the worst of the best 20 found so far is left out. Scores are 64-bit integers and
bounds use the same integer formula, so nothing is lost to rounding. The best of each task
meet in one ranking per item.

The items are the query set and are held by every task, as their terms are (in a table in the
shared folder that Spark writes); nothing held grows with the documents.

Null texts and texts without a term are no documents to be found. Null or empty items give no
rows; of rows that repeat an item id the smallest text counts, a null id is an id like any
other. Repeated documents are all ranked; a null doc_id comes after all others of equal score.
Empty tables give an empty result. Other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.llm.common import documents, process_cache, reading, shared_folder, stored, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

TOP = 20
# Documents per tree and per leaf.
TREE = 16_384
LEAF = 48
# Rows per range partition.
ROWS = 16_000
# Terms of a restricted vector by which documents are laid out.
LAYOUT = 12

GAIN, TF_PART, M_PART = 1_000_000_000, 1000, 12


def terms(text: str | None) -> list[str]:
    # Bytes know only A to Z as upper case.
    return TERM.findall(text.encode("utf-8", "replace").lower().decode()) if text else []


def items_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, text: one row per id."""
    return items.groupBy(F.col(id_col).alias("item_id")).agg(F.min(text_col).alias("text"))


def write_items(spark: SparkSession, items: DataFrame) -> str:
    """The items' terms with how often they ask for each, as one file of the shared folder."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, Counter(terms(t))) for i, t in zip(*(batch.column(c).to_pylist() for c in ("item_id", "text")))]
            flat = [(i, term, n) for i, count in rows for term, n in sorted(count.items())]
            columns = list(zip(*flat)) or [[], [], []]
            types = [batch.column("item_id").type, pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["item_id", "term", "asked"]
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return held_file(spark, items.mapInArrow(asked, f"item_id {kind}, term string, asked long"), "items")


def held_file(spark: SparkSession, df: DataFrame, name: str) -> str:
    """Write a table that every task is to hold as one file; returns its address."""
    folder = shared_folder(spark, name)
    df.coalesce(1).write.mode("overwrite").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return f"{folder}/{next(n for n in sorted(names) if n.endswith('.parquet'))}"


def held(address: str) -> pa.Table:
    """The table, read once per process."""
    cache = process_cache("lexical")
    if address not in cache:
        with reading(address) as file:
            cache[address] = pq.read_table(file)
    return cache[address]


def restricted_rows(docs: DataFrame, address: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, tfs of every document: its number of terms, and what items ask for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(held(address).column("term").to_pylist()).__contains__
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            sizes, found, counts = [], [], []
            for text in texts:
                words = terms(text.as_py())
                count = Counter(filter(known, words))
                sizes.append(len(words))
                found.append(list(count))
                counts.append(list(count.values()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n long, terms array<string>, tfs array<long>")


def weight(documents_in_all: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * documents_in_all + 2) / (2 * with_term + 1)))


def points(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one asked term of weight one adds: more for a larger tf, less for a larger m."""
    return (GAIN * tf) // (TF_PART * tf + M_PART * m)


class Tree:
    """Documents in the order of their vectors, and the nodes over them.

    Rows hold term numbers (0 is the most frequent) in ascending order. Of each node there are
    the first and last document, the children, and as a sparse row what each term adds to a
    score at most: by its largest frequency in the subtree at the subtree's smallest m.
    """

    def __init__(self, ids: list, starts: np.ndarray, numbers: np.ndarray, tfs: np.ndarray, m: np.ndarray):
        self.ids, self.starts, self.numbers, self.tfs, self.m = ids, starts, numbers, tfs, m
        self.points = points(tfs, np.repeat(m, np.diff(starts)))
        self.largest_tf = np.zeros(int(numbers.max()) + 1 if len(numbers) else 0, np.int64)
        self.children: list[list[int]] = []
        self.span: list[tuple[int, int]] = []
        self.most: list[tuple[np.ndarray, np.ndarray]] = []
        if len(ids):
            self.build()

    def build(self) -> None:
        """Split documents that share a beginning by their next term, down to leaves."""
        work = [(0, len(self.ids), 0, -1)]
        while work:
            first, last, depth, parent = work.pop()
            node = len(self.span)
            self.span.append((first, last))
            self.children.append([])
            self.most.append(self.at_most(first, last))
            if parent >= 0:
                self.children[parent].append(node)
            if last - first <= LEAF:
                continue
            at = self.starts[first:last] + depth
            ended = at >= self.starts[first + 1 : last + 1]
            following = np.where(ended, -1, self.numbers[np.minimum(at, max(0, len(self.numbers) - 1))])
            cuts = first + 1 + np.flatnonzero(np.diff(following))
            edges = [first, *cuts.tolist(), last]
            if len(edges) == 2 and ended.any():
                # Equal vectors: nothing sets them apart but m; cut by number.
                edges = [*range(first, last, LEAF), last]
                work += [(a, b, depth, node) for a, b in zip(edges, edges[1:])]
                continue
            # Rare next terms share a node, so that no node has a child per document.
            start = first
            for a, b in zip(edges, edges[1:]):
                if b - a > LEAF:
                    if a > start:
                        work += [(x, min(x + LEAF, a), depth, node) for x in range(start, a, LEAF)]
                    work.append((a, b, depth + 1, node))
                    start = b
                elif b - start > LEAF:
                    work.append((start, a, depth, node))
                    start = a
            if last > start:
                work.append((start, last, depth, node))

    def at_most(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        here = slice(self.starts[first], self.starts[last])
        self.largest_tf[:] = 0
        np.maximum.at(self.largest_tf, self.numbers[here], self.tfs[here])
        numbers = np.flatnonzero(self.largest_tf)
        return numbers, points(self.largest_tf[numbers], self.m[first:last].min())

    def bound(self, node: int, asked: np.ndarray) -> int:
        """No document of the subtree scores more. ``asked`` has weight times repeats per term."""
        numbers, most = self.most[node]
        return int(asked[numbers] @ most)

    def scores(self, first: int, last: int, asked: np.ndarray) -> np.ndarray:
        here = slice(self.starts[first], self.starts[last])
        # Every document here has a term, so no range is empty.
        each = asked[self.numbers[here]] * self.points[here]
        return np.add.reduceat(each, self.starts[first:last] - self.starts[first])

    def search(self, asked: np.ndarray, best: list[tuple], top: int) -> list[tuple]:
        """The best documents of this tree and the ones before: (minus score, no id, id)."""
        if not self.span:
            return best
        worst = -best[-1][0] if len(best) == top else 1
        stack = [(self.bound(0, asked), 0)]
        while stack:
            most, node = stack.pop()
            if most < worst:
                continue
            if self.children[node]:
                ranked = sorted((self.bound(c, asked), c) for c in self.children[node])
                stack += [x for x in ranked if x[0] >= worst]
                continue
            first, last = self.span[node]
            found = self.scores(first, last, asked)
            at = np.flatnonzero(found >= max(worst, 1))
            if len(at):
                new = [(-int(found[i]), self.ids[first + i] is None, self.ids[first + i]) for i in at]
                best = sorted([*best, *new], key=order_key)[:top]
                worst = -best[-1][0] if len(best) == top else 1
        return best


def order_key(row: tuple) -> tuple:
    return row[:2] if row[1] else row


def trees(batches: Iterator[pa.RecordBatch], size: int, doc_count: int, term_count: int) -> Iterator[Tree]:
    """The rows of a task in trees of so many documents, in the order of their vectors."""
    rows: list[tuple] = []

    def tree() -> Tree:
        rows.sort(key=lambda r: r[0])
        lengths = [len(r[0]) for r in rows]
        n = np.array([r[3] for r in rows], np.int64)
        flat = [np.array([x for r in rows for x in r[i]], np.int64) for i in (0, 1)]
        # Whole numbers of any size first: documents times terms may leave 64 bits.
        m = np.array([100 - 25 + 25 * int(x) * doc_count // term_count for x in n], np.int64)
        return Tree([r[2] for r in rows], np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), *flat, m)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("numbers", "tfs", "doc_id", "n"))):
            rows.append(row)
            if len(rows) == size:
                yield tree()
                rows = []
    if rows:
        yield tree()


def lexical_search(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    tree: int = TREE,
) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item."""
    asked_file = write_items(spark, items_of(items, item_col, item_text))
    rows = stored(spark, restricted_rows(docs, asked_file, id_col, text_col), "restricted")
    doc_count, term_count, with_any = rows.filter("n > 0").agg(
        F.count("*"), F.sum("n"), F.count_if(F.size("terms") > 0)
    ).first()
    item_type, id_type = items.schema[item_col].dataType, docs.schema[id_col].dataType
    kinds, found_kind = item_type.simpleString(), id_type.simpleString()
    result = f"item_id {kinds}, doc_id {found_kind}, score long"
    result_types = [to_arrow_type(item_type), to_arrow_type(id_type), pa.int64()]
    if not with_any:
        return spark.createDataFrame([], f"item_id {kinds}, rank int, doc_id {found_kind}, score long")
    # At most the items' terms: numbered from the most frequent on.
    frequency = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms_file = held_file(spark, frequency, "terms")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = term_numbers(terms_file)
        for batch in batches:
            vectors, counts = [], []
            for some, tfs in zip(batch.column("terms").to_pylist(), batch.column("tfs").to_pylist()):
                pairs = sorted((number[t][0], tf) for t, tf in zip(some, tfs))
                vectors.append([p[0] for p in pairs])
                counts.append([p[1] for p in pairs])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n"),
                    pa.array(vectors, pa.list_(pa.int64())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "numbers", "tfs"],
            )

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = term_numbers(terms_file)
        wanted = wanted_terms(asked_file, number, doc_count)
        best: dict = {item: [] for item, _ in wanted}
        for some in trees(batches, tree, doc_count, term_count):
            for item, asked in wanted:
                best[item] = some.search(asked, best[item], top)
        flat = [(item, row[2], -row[0]) for item, found in best.items() for row in found]
        columns = list(zip(*flat)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, result_types)], ["item_id", "doc_id", "score"]
        )

    vectors = rows.filter(F.size("terms") > 0).mapInArrow(
        numbered, f"doc_id {found_kind}, n long, numbers array<long>, tfs array<long>"
    )
    parts = max(1, math.ceil(with_any / ROWS))
    # Equal vectors may be a third of all rows: the id cuts them, and rows without one by chance of n.
    laid = vectors.repartitionByRange(parts, F.slice("numbers", 1, LAYOUT), F.xxhash64("doc_id"), "n")
    spread = laid.mapInArrow(best_of, result)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (
        spread.withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= top)
        .select("item_id", "rank", "doc_id", "score")
    )


def term_numbers(address: str) -> dict[str, tuple[int, int]]:
    """Number and document frequency of each term, the most frequent first."""
    cache = process_cache("lexical-numbers")
    if address not in cache:
        rows = held(address).to_pydict()
        ranked = sorted(zip(rows["term"], rows["df"]), key=lambda r: (-r[1], r[0]))
        cache[address] = {term: (i, df) for i, (term, df) in enumerate(ranked)}
    return cache[address]


def wanted_terms(address: str, number: dict[str, tuple[int, int]], doc_count: int) -> list[tuple]:
    """Per item: weight times repeats of each term, by term number."""
    rows = held(address).to_pydict()
    wanted: dict = {}
    for item, term, n in zip(rows["item_id"], rows["term"], rows["asked"]):
        if term in number:
            at, df = number[term]
            wanted.setdefault(item, np.zeros(len(number), np.int64))[at] = n * weight(doc_count, df)
    return list(wanted.items())


def op13_fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH q AS (
  SELECT item_id, term, count(*) AS asked
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY 1) b) x
  GROUP BY ALL),
d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS terms FROM documents),
held AS (SELECT k, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, sum(n) AS words FROM held),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM held) x
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term),
measures AS (SELECT k, doc_id, 75 + CAST(25 * n * docs // CAST(words AS BIGINT) AS BIGINT) AS m FROM held, totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(asked * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score, k
  FROM q JOIN tf USING (term) JOIN weights USING (term) JOIN measures USING (k) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) r
WHERE rank <= 20
"""
