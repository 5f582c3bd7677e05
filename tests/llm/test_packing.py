from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from ledgerline.llm import packing
from ledgerline.llm.tokens import default_path


def places(counts, capacity):
    """(length, rank) of every piece with its sequence and offset."""
    out = {}
    for s in packing.plan(counts, capacity):
        for i in range(s.count):
            out[(s.length, s.first_rank + i)] = (s.first_sequence + i, s.offset)
    return out


def check(counts, capacity):
    got = places(counts, capacity)
    assert set(got) == {(k, i) for k, n in counts.items() for i in range(n)}
    by_sequence = defaultdict(list)
    for (length, _), (sequence, offset) in got.items():
        by_sequence[sequence].append((offset, length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def at_least(counts, capacity):
    """Sequences that any packing needs: pieces too long to share one, and the room left beside them."""
    best = 0
    for small in range(capacity // 2 + 1):
        alone = sum(n for k, n in counts.items() if k > capacity - small)
        large = {k: n for k, n in counts.items() if capacity / 2 < k <= capacity - small}
        room = sum(n * (capacity - k) for k, n in large.items())
        rest = sum(k * n for k, n in counts.items() if small <= k <= capacity / 2)
        best = max(best, alone + sum(large.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def fewest(sizes, capacity):
    """Bins of an optimal packing: next fit over all orders."""
    best = len(sizes)
    for order in set(permutations(sizes)):
        bins, room = 0, 0
        for size in order:
            if size > room:
                bins, room = bins + 1, capacity
            room -= size
        best = min(best, bins)
    return best


def test_plans_are_whole_and_tight():
    draw = random.Random(3)
    for _ in range(60):
        capacity = draw.choice([10, 17, 64])
        counts = {k: draw.randrange(1, 9) for k in draw.sample(range(1, capacity + 1), 6)}
        assert check(counts, capacity) <= 11 * at_least(counts, capacity) / 9 + 1


def test_dominance_reduction_loses_nothing():
    """What is fixed and an optimal packing of the rest are together optimal."""
    draw = random.Random(8)
    for _ in range(80):
        sizes = [draw.randrange(1, 12) for _ in range(6)]
        fixed, left = packing.reduce_by_dominance(dict(Counter(sizes)), 12)
        rest = [k for k, n in left.items() for _ in range(n)]
        assert all(sum(held) <= 12 for held, _ in fixed)
        assert sum(n for _, n in fixed) + (fewest(rest, 12) if rest else 0) == fewest(sizes, 12)


def test_large_counts_are_planned_in_bulk():
    counts = {k: 10**9 + k for k in range(1, 1025, 7)}
    slots = packing.plan(counts)
    assert len(slots) < 100_000
    assert Counter({k: sum(s.count for s in slots if s.length == k) for k in (1, 512, 1023) if k in counts}) == Counter(
        {k: counts[k] for k in (1, 512, 1023) if k in counts}
    )


def test_pieces_of_odd_documents(spark, tricky, no_docs):
    import zlib

    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(default_path())
    rows = packing.pack(spark, tricky, capacity=64).collect()
    want = Counter()
    for r in tricky.collect():
        ids = np.array([*tool.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        cut = len(ids) % 64 or 64
        edges = [0, *range(cut, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(r["doc_id"], piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for sequence in held.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(spark, no_docs).count() == 0


def test_few_sequences(spark, small_docs):
    rows = packing.pack(spark, small_docs).select("sequence_id", "length").toPandas()
    assert rows["sequence_id"].nunique() <= 1.02 * rows["length"].sum() / 1024 + 1
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024


@pytest.mark.parametrize("counts", [{}, {5: 1}, {1024: 3}])
def test_trivial_plans(counts):
    assert check(counts, 1024) == (sum(counts.values()))
