"""Best-fit packing of documents into token sequences.

A document is its token ids and an end id; longer ones than a sequence are cut into full
pieces, the remainder first. How pieces are combined depends on their lengths alone, so the
plan is made on the count of pieces per length: at most as many numbers as a sequence has
tokens, whatever the size of the corpus.

The plan first applies the dominance reduction of Martello and Toth: a piece, taken from the
longest on, is fixed for good with the partner, or alone, when no other set that fits with it
can do better. What remains is packed best fit, longest first. Patterns of the plan are then
dealt to pieces by their rank among the pieces of their length, which comes from counts per
task and not from a sort of all pieces.

Null and empty texts are one end id. Repeated rows are packed each on their own. An empty table
gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, stored
from ledgerline.llm.tokens import default_path, document_ids, encoder

SEQUENCE = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, path: str, capacity: int = SEQUENCE) -> DataFrame:
    """One row per piece with its rank among the task's pieces of the same length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = document_ids(tool, text)
                total, start, number = len(ids) // 4, 0, 0
                while start < total:
                    length = (total - start) % capacity or capacity
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((doc, number, start, length, crc, part, int(seen[length])))
                    seen[length] += 1
                    start, number = start + length, number + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


@dataclass(frozen=True)
class Slot:
    """A run of pieces of one length, by rank, and where they go."""

    length: int
    first_rank: int
    count: int
    first_sequence: int
    offset: int


class _Lengths:
    """Counts of pieces by length, with the largest one that fits."""

    def __init__(self, counts: dict[int, int]):
        self.left = Counter({k: v for k, v in counts.items() if v > 0})
        self.order = sorted(self.left)

    def largest(self, room: int) -> int:
        """The longest piece within the room, 0 if there is none."""
        fit = [k for k in self.order if k <= room]
        return fit[-1] if fit else 0

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.order.remove(length)


def best_pair(lengths: _Lengths, room: int) -> int:
    """The largest sum within the room of two pieces that are there."""
    best, low, high = 0, 0, len(lengths.order) - 1
    order = lengths.order
    while low <= high:
        total = order[low] + order[high]
        if total > room:
            high -= 1
            continue
        if low != high or lengths.left[order[low]] > 1:
            best = max(best, total)
        low += 1
    return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets of at most two pieces that dominate all others, and the counts that remain.

    For the longest piece, with room r beside it and q the longest piece that fits there:
    alone if nothing fits; with q if q fills the room, if no two of the others fit beside it,
    or if q is at least as long as every pair that fits and no three fit. Each set that could
    replace it then exchanges piecewise for the chosen one, so an optimal packing contains it.
    Fixing pieces leaves fewer alternatives, so what holds for one copy holds for all of them.
    """
    lengths, fixed = _Lengths(counts), []
    for length in sorted(lengths.order, reverse=True):
        while lengths.left.get(length, 0):
            room, have = capacity - length, lengths.left[length]
            partner = lengths.largest(room)
            if partner == length and have == 1:
                partner = max((k for k in lengths.order if k < length and k <= room), default=0)
            if not partner:
                fixed.append(((length,), have))
                lengths.take(length, have)
                break
            rest = Counter(lengths.left)
            rest[length] -= 1
            smallest = sorted(k for k, v in rest.items() for _ in range(min(v, 3)))[:3]
            two, three = sum(smallest[:2]) <= room and len(smallest) > 1, sum(smallest) <= room and len(smallest) > 2
            if not (partner == room or not two or (not three and partner >= best_pair(lengths, room))):
                break
            n = have // 2 if partner == length else min(have, lengths.left[partner])
            fixed.append(((length, partner), n))
            lengths.take(length, n)
            lengths.take(partner, n)
    return fixed, dict(lengths.left)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest piece first, on equal sequences at a time: (lengths, how many)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for room in sorted(k for k in open_ if k >= length):
            if not n:
                break
            each, groups = room // length, open_.pop(room)
            for held, many in groups:
                full = min(many, n // each)
                if full:
                    open_[room - each * length].append((held + (length,) * each, full))
                    n, many = n - full * each, many - full
                if many and n:
                    open_[room - n * length].append((held + (length,) * n, 1))
                    many, n = many - 1, 0
                if many:
                    open_[room].append((held, many))
        each = capacity // length
        if n >= each:
            open_[capacity - each * length].append(((length,) * each, n // each))
        if n % each:
            open_[capacity - (n % each) * length].append(((length,) * (n % each), 1))
    return [group for groups in open_.values() for group in groups]


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> list[Slot]:
    """Where the pieces of each length go, by rank."""
    fixed, left = reduce_by_dominance(counts, capacity)
    slots, ranks, sequence = [], Counter(), 0
    for held, many in fixed + best_fit(left, capacity):
        offset = 0
        for length in held:
            slots.append(Slot(length, ranks[length], many, sequence, offset))
            ranks[length] += many
            offset += length
        sequence += many
    return sorted(slots, key=lambda s: (s.length, s.first_rank))


def place(ranked: DataFrame, slots: list[Slot]) -> DataFrame:
    """sequence_id and offset of each piece; the slots are a plan, not data."""
    length = np.array([s.length for s in slots], dtype=np.int64)
    first = np.array([s.first_rank for s in slots], dtype=np.int64)
    sequence = np.array([s.first_sequence for s in slots], dtype=np.int64)
    offset = np.array([s.offset for s in slots], dtype=np.int64)
    begin = {int(k): int(np.searchsorted(length, k)) for k in np.unique(length)}
    end = {k: int(np.searchsorted(length, k, "right")) for k in begin}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.zeros(len(size), dtype=np.int64)
            for k in np.unique(size):
                mine = size == k
                at[mine] = begin[int(k)] + np.searchsorted(first[begin[int(k)] : end[int(k)]], rank[mine], "right") - 1
            columns = [batch.column(i) for i in range(5)]
            columns += [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(look_up, schema)


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    cut = stored(spark, pieces(docs, path or default_path(), capacity), "pieces")
    by_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    return place(ranked, plan(counts, capacity))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir))
