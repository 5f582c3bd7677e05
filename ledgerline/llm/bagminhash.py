"""Near duplicates by BagMinHash.

A document is the multiset of its runs of five words. Hierarchical Poisson processes over
discretised weights give it registers that agree with another document's as often as their
multisets overlap (weighted Jaccard). Four registers make a band key; documents that share one
are candidates, and each link is verified on the multisets themselves: similarity 0.8 or more.

Documents with equal multisets are one node and are not compared. In a bucket, members are
compared with one pivot a round, never all with all, and only across classes not yet joined.
What a few rounds leave unresolved is settled by comparing the members of unresolved buckets
in blocks: pairs whose registers allow the similarity are verified there, and only links that
join two classes come out. The 64 registers miss a
pair at 0.8 with a probability of about 0.0005 (bands and blocks together), and less above.
Multisets are compared by 32-bit numbers; at n runs a similarity is off by about n / 2**32.

A document shorter than five words is one run. Null, empty and blank texts have no run: each is
a class of its own. Repeated rows fall into one class. An empty table gives an empty result.
Columns beside doc_id and text may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerline.llm.common import SPACE, documents, empty_if_null, stored

WORDS = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4

# Rounds in which buckets compare their members with a pivot.
ROUNDS = 3
# Registers (of BANDS * ROWS) that have to agree for a pair of an unresolved bucket to be
# verified: 3.5 standard deviations below what similarity 0.8 makes agree.
AGREE = 40
# Members of a bucket that are compared at a time, and the runs of words they hold together.
BLOCK = 256
BLOCK_ITEMS = 2_000_000

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A draw in (0, 1] that seed and number fix."""
    bits = mixed(seed + number * GOLDEN) >> U(11)
    return (bits.astype(np.float64) + 1.0) * 2.0**-53


def shingles(words: np.ndarray, ends: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of words; a shorter document is one run."""
    starts = np.concatenate([[0], ends[:-1]])
    length = ends - starts
    runs = np.where(length > 0, np.maximum(length - size + 1, 1), 0)
    doc = np.repeat(np.arange(len(ends)), runs)
    first = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + starts[doc]
    value = np.zeros(len(first), dtype=U)
    for k in range(size):
        at = first + k
        inside = at < ends[doc]
        value = mixed(value * GOLDEN + np.where(inside, words[np.minimum(at, len(words) - 1)], U(0)))
    return doc, value


def signatures(doc: np.ndarray, value: np.ndarray, count: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """BagMinHash registers of each document, as arrival times.

    The weight axis of an element is cut at powers of two. Each part is a Poisson process of
    its own whose points carry a level within the part and a register; an element takes the
    points whose level lies below its count, so two documents share exactly the processes of
    their common weight, and a register agrees with the weighted Jaccard similarity as
    probability. Points are made in order of time, up to a time by which the registers are
    likely full, and beyond it only for documents that still have an empty one.
    """
    parts = 1 + np.where(count > 1, np.frexp((count - 1).astype(np.float64))[1], 0)
    element = np.repeat(np.arange(len(doc)), parts)
    part = np.arange(len(element)) - np.repeat(np.cumsum(parts) - parts, parts)
    owner, weight = doc[element], count[element]
    base = np.where(part > 0, 1 << np.maximum(part - 1, 0), 0)
    rate = np.maximum(base, 1).astype(np.float64)
    seed = mixed(value[element] + (part.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
    time = -np.log(uniform(seed, np.ones(len(seed), dtype=U))) / rate
    number = np.ones(len(seed), dtype=U)
    total = np.bincount(doc, weights=count, minlength=docs)
    horizon = registers * (np.log(registers) + 1.0) / np.maximum(total, 1.0)
    found = np.full(docs * registers, np.inf)
    pending = np.arange(len(seed))
    while len(pending):
        at = pending[time[pending] <= horizon[owner[pending]]]
        while len(at):
            draw = mixed(seed[at] ^ (number[at] * U(0xA24BAED4963EE407)))
            level = base[at] + (uniform(seed[at], number[at] + U(1 << 40)) * rate[at]).astype(np.int64).clip(0, base[at].clip(1) - 1)
            kept = level < weight[at]
            slot = owner[at] * registers + (draw % U(registers)).astype(np.int64)
            np.minimum.at(found, slot[kept], time[at][kept])
            number[at] += U(1)
            time[at] += -np.log(uniform(seed[at], number[at])) / rate[at]
            at = at[time[at] <= horizon[owner[at]]]
        open_ = np.isinf(found.reshape(docs, registers)).any(axis=1)
        pending = pending[open_[owner[pending]]]
        horizon[open_] *= 1.5
    return found.reshape(docs, registers)


def items_of(doc: np.ndarray, value: np.ndarray, docs: int) -> tuple[list, list]:
    """Per document: fingerprint of its multiset, and the multiset as sorted 32-bit numbers.

    ``doc`` and ``value`` are sorted. The k-th copy of a run is an item of its own, so the
    overlap of multisets is that of sets.
    """
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    begin = np.nonzero(new)[0]
    count = np.diff(np.append(begin, len(doc)))
    copy = np.arange(len(doc)) - np.repeat(begin, count)
    item = (mixed(value + copy.astype(U) * GOLDEN) >> U(32)).astype("<u4")
    cut = np.searchsorted(doc, np.arange(docs + 1))
    parts = [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]
    return prints_of(value, parts), [np.sort(item[p]).tobytes() for p in parts]


def prints_of(value: np.ndarray, parts: list[slice]) -> list:
    return [hashlib.blake2b(value[p].tobytes(), digest_size=16).digest() if p.start < p.stop else None for p in parts]


def sketch(doc: np.ndarray, value: np.ndarray, docs: int, bands: int, rows: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Per document: fingerprint, band keys, and four bytes of each register.

    ``doc`` and ``value`` are sorted.
    """
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    begin = np.nonzero(new)[0]
    count = np.diff(np.append(begin, len(doc)))
    cut = np.searchsorted(doc, np.arange(docs + 1))
    prints = prints_of(value, [slice(a, b) for a, b in zip(cut[:-1], cut[1:])])
    full = np.diff(cut) > 0
    dense = np.cumsum(full) - 1
    times = signatures(dense[doc[begin]], value[begin], count, int(full.sum()), bands * rows)
    bits = mixed(times.view(U)).reshape(len(times), bands, rows)
    keys = np.zeros((len(times), bands), dtype=U) + np.arange(1, bands + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)
    for r in range(rows):
        keys = mixed(keys * GOLDEN + bits[:, :, r])
    every = np.zeros((docs, bands), dtype=U)
    every[full] = keys
    short = np.zeros((docs, bands * rows), dtype="<u4")
    short[full] = (bits.reshape(len(times), bands * rows) & U(0xFFFFFFFF)).astype("<u4")
    return prints, every.view(np.int64), short


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the runs of a slice fit into memory many times over."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def word_hashes(text: str = "text"):
    return F.transform(F.array_remove(F.split(empty_if_null(text), SPACE), ""), lambda w: F.xxhash64(w))


def sorted_runs(lists: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, hash) of all runs of a batch of word-hash lists, sorted."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(U)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    doc, value = shingles(flat, ends, words)
    order = np.lexsort((value, doc))
    return doc[order], value[order], len(ends)


def sketches(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One sketch per row. Words are hashed by Spark, runs of them in Arrow batches."""
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row_no"),
        F.xxhash64(empty_if_null("text")).alias("mark"),
        word_hashes().alias("words"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches):
            doc, value, size = sorted_runs(part.column("words"), words)
            prints, keys, short = sketch(doc, value, size, bands, rows)
            offsets = pa.array(np.arange(0, (size + 1) * bands, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row_no"),
                    part.column("mark"),
                    pa.array(np.bincount(doc, minlength=size).astype(np.int64)),
                    pa.array(prints, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                    pa.array([x.tobytes() for x in short], pa.binary()),
                ],
                names=["doc_id", "row_no", "mark", "n", "print", "bands", "registers"],
            )

    return hashed.mapInArrow(
        run, "doc_id long, row_no long, mark long, n long, print binary, bands array<long>, registers binary"
    )


def multisets(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """node, n, items of the given nodes, from the texts of the documents that stand for them."""
    ids = nodes.select(F.col("doc_id").alias("__id")).distinct()
    some = docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches):
            doc, value, size = sorted_runs(part.column("words"), words)
            prints, items = items_of(doc, value, size)
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(items, pa.binary())], names=["print", "items"])

    found = some.select(word_hashes().alias("words")).mapInArrow(run, "print binary, items binary")
    once = found.groupBy("print").agg(F.first("items").alias("items"))
    return nodes.join(once, "print").select("node", "n", "items")


@F.pandas_udf(LongType())
def overlap(left: pd.Series, right: pd.Series) -> pd.Series:
    def common(a: bytes, b: bytes) -> int:
        return len(np.intersect1d(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), assume_unique=True))

    return pd.Series([common(a, b) for a, b in zip(left, right)], dtype="int64")


def verified(pairs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those whose multisets are similar enough."""
    left = items.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = items.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    both = pairs.distinct().join(left, "a").join(right, "b").withColumn("common", overlap("ia", "ib"))
    return both.filter(
        F.col("common") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("common")) - 1e-9
    ).select("a", "b")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that links lead to, by lowest labels and pointer jumps."""
    swapped = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = stored(spark, links.unionByName(swapped).distinct(), "links")
    labels = stored(
        spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels"
    )
    total = F.sum(F.col("comp").cast("decimal(38,0)"))
    before = None
    while True:
        now = labels.agg(total).first()[0]
        if now is None or now == before:
            return labels
        before = now
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("low"))
        lowered = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("comp", "low").alias("comp"))
        jump = lowered.select(F.col("node").alias("at"), F.col("comp").alias("to"))
        labels = stored(
            spark,
            lowered.join(jump, F.col("comp") == F.col("at")).select("node", F.least("comp", "to").alias("comp")),
            "labels",
        )


def similar_length(similarity: float):
    """What two sizes allow: the smaller multiset is part of the larger one at best."""
    return F.least("n", "pn") >= F.lit(similarity) * F.greatest("n", "pn") - 1e-9


def unresolved(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their class; without labels each node is a class of its own."""
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    known = labels.select(F.col("node").alias("at"), F.col("comp").alias("label"))
    return members.join(known, F.col("node") == F.col("at"), "left").select(
        *[F.col(c) for c in members.columns], F.coalesce("label", "node").alias("comp")
    )


def open_buckets(rows: DataFrame, seed: int) -> DataFrame:
    """Buckets with more than one class, and their pivot; the first round takes the first node."""
    order = F.col("node") if seed == 0 else F.xxhash64("node", "key", F.lit(seed))
    return (
        rows.groupBy("key")
        .agg(
            F.count("*").alias("size"),
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
            F.min_by(F.struct("node", "n", "comp"), order).alias("pivot"),
        )
        .filter("low <> high")
        .select("key", "size", F.col("pivot.node").alias("pnode"), F.col("pivot.n").alias("pn"), F.col("pivot.comp").alias("pcomp"))
    )


def block_links(
    rows: DataFrame, texts: DataFrame, similarity: float, agree: int = AGREE, block: int = BLOCK
) -> DataFrame:
    """Verified links (a, b) that join the classes of unresolved buckets.

    ``texts`` has registers and items of each node. A bucket is dealt into blocks of members;
    two blocks at a time meet in a task, which holds no more than their texts. A pair is looked
    at once, under the first band that it shares, and only while its classes are not joined:
    what comes out is no longer than what goes in.
    """
    buckets = (
        rows.groupBy("key")
        .agg(F.count("*").alias("size"), F.sum("n").alias("items_in"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        .filter("low <> high")
    )
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("items_in") / BLOCK_ITEMS)).cast("int")
    wide = (
        rows.join(buckets.select("key", blocks.alias("blocks")), "key")
        .join(texts, "node")
        .withColumn("mine", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            "key", "band", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"),
            "mine", "node", "n", "comp", "registers", "items",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (b for b in batches if b.num_rows):
            # A group ends where the next one begins; the last one may go on in the next batch.
            whole = group_starts(batch)[-1]
            if whole or (held and new_group(held[-1], batch)):
                yield link_groups(pa.Table.from_batches([*held, batch.slice(0, whole)]), similarity, agree)
                held = [batch.slice(whole)]
            else:
                held.append(batch)
        if held:
            yield link_groups(pa.Table.from_batches(held), similarity, agree)

    keys = ["key", "b1", "b2"]
    return wide.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def group_columns(batch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy() for c in ("key", "b1", "b2")]


def group_starts(batch) -> np.ndarray:
    """Rows at which a group of (key, b1, b2) begins."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for column in group_columns(batch):
        new[1:] |= column[1:] != column[:-1]
    return np.nonzero(new)[0]


def new_group(before, after) -> bool:
    return any(x[-1] != y[0] for x, y in zip(group_columns(before), group_columns(after)))


def link_groups(table: pa.Table, similarity: float, agree: int) -> pa.RecordBatch:
    """Links that join classes within each group of (key, b1, b2)."""
    table = table.combine_chunks()
    node, n, label, mine, b1, b2, band = (
        table.column(c).to_numpy() for c in ("node", "n", "comp", "mine", "b1", "b2", "band")
    )
    label = label.copy()
    registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u4").reshape(len(node), -1)
    items = table.column("items")
    starts = np.append(group_starts(table), len(node)) if len(node) else np.zeros(1, dtype=np.int64)
    found: list[tuple[int, int]] = []
    for start, end in zip(starts[:-1], starts[1:]):
        rows = np.arange(start, end)
        same_block = b1[start] == b2[start]
        left = rows[mine[rows] == b1[start]]
        right = left if same_block else rows[mine[rows] == b2[start]]
        held = {r: np.frombuffer(items[int(r)].as_py(), "<u4") for r in rows} if len(np.unique(label[rows])) > 1 else {}
        for i in left if held else ():
            js = right[(label[right] != label[i]) & ((node[right] > node[i]) | (not same_block))]
            js = js[np.minimum(n[js], n[i]) >= similarity * np.maximum(n[js], n[i]) - 1e-9]
            same = registers[js] == registers[i]
            js, same = js[(enough := same.sum(axis=1) >= agree)], same[enough]
            if not len(js):
                continue
            first_band = same.reshape(len(js), -1, ROWS).all(axis=2).argmax(axis=1)
            for j in js[first_band == band[start]]:
                if label[j] != label[i] and similar(held[i], held[j], similarity):
                    found.append((int(node[i]), int(node[j])))
                    members = label[rows]
                    members[members == label[j]] = label[i]
                    label[rows] = members
    ends = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends.max(axis=1)), pa.array(ends.min(axis=1))], names=["a", "b"])


def similar(left: np.ndarray, right: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(left, right, assume_unique=True))
    return common >= similarity * (len(left) + len(right) - common) - 1e-9


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, verified_links, kept: one row per document.

    ``verified_links`` counts the verified links of the document's text to other texts; texts
    that other links had put in one class by then are not compared. ``kept`` is
    true for one document of each class, ``mark`` is a hash of the text.
    """
    rows = stored(spark, sketches(docs), "sketches")
    nodes = stored(
        spark,
        rows.filter("n > 0")
        .groupBy("print")
        .agg(F.min(F.struct("row_no", "doc_id", "n")).alias("x"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
        .select("print", F.col("x.row_no").alias("node"), F.col("x.doc_id").alias("doc_id"), F.col("x.n").alias("n"), "bands", "registers"),
        "nodes",
    )
    placed = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    members = stored(spark, placed.join(shared, "key"), "members")
    compared = nodes.join(members.select("node").distinct(), "node", "left_semi")
    items = stored(spark, multisets(docs, compared), "multisets")

    links, labels = None, None
    for turn in range(ROUNDS):
        current = unresolved(members, labels)
        pivots = open_buckets(current, turn)
        pairs = (
            current.join(pivots, "key")
            .filter((F.col("comp") != F.col("pcomp")) & similar_length(similarity))
            .select(F.greatest("node", "pnode").alias("a"), F.least("node", "pnode").alias("b"))
        )
        found = stored(spark, verified(pairs, items, similarity), "verified")
        links = found if links is None else links.unionByName(found)
        labels = components(spark, links)
    texts = nodes.select("node", "registers").join(items.select("node", "items"), "node")
    rest = block_links(unresolved(members, labels), texts, similarity)
    links = stored(spark, links.unionByName(rest).distinct(), "verified")
    labels = components(spark, links)

    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("links"))
    classed = (
        nodes.select("print", "node")
        .join(labels, "node", "left")
        .join(degree, "node", "left")
        .select("print", F.coalesce("comp", "node").alias("comp"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    # Texts without a run have no print; each row is its own class.
    each = rows.select("doc_id", "row_no", "mark", "print").join(classed, "print", "left").select(
        "doc_id", "row_no", "mark", F.coalesce("comp", "row_no").alias("comp"), F.coalesce("links", F.lit(0)).alias("links")
    )
    each = stored(spark, each, "classes")
    sizes = each.groupBy(F.col("comp").alias("c")).agg(
        F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no")).alias("first")
    )
    return each.join(sizes, F.col("comp") == F.col("c")).select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        F.col("links").alias("verified_links"),
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        "mark",
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns."""
    none = F.lit(-(2**63))
    stay = (
        near_duplicates(spark, docs, similarity)
        .filter("kept")
        .select(F.coalesce("doc_id", none).alias("__id"), F.col("mark").alias("__mark"))
        .distinct()
    )
    keys = ["__id", "__mark"]
    marked = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), none)).withColumn(
        "__mark", F.xxhash64(empty_if_null("text"))
    )
    # Rows that repeat both id and text are one class, so the first of them is enough.
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    return (
        marked.join(stay, keys, "left_semi")
        .withColumn("__nth", first)
        .filter(F.col("__nth") == 1)
        .select(*[F.col(c) for c in docs.columns])
    )


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir)).drop("mark")
