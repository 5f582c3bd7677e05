from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import bagminhash

SF = "/root/testdata/sf0.01"


def multiset(text):
    words = (text or "").split()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def classes(docs, threshold=0.8):
    """Connected classes by brute force over all documents that share a run."""
    sets = {i: multiset(t) for i, t in docs}
    holders = defaultdict(set)
    for i, s in sets.items():
        for run in s:
            holders[run].add(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if find(a) != find(b) and similarity(sets[a], sets[b]) >= threshold:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_registers_agree_as_often_as_multisets_overlap():
    draw = np.random.default_rng(1)
    off = []
    for _ in range(30):
        values = draw.integers(0, 2**63, 150).astype(np.uint64)
        a = draw.integers(0, 7, 150)
        b = np.where(draw.random(150) < 0.7, a, draw.integers(0, 9, 150))
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        times = bagminhash.signatures(
            doc, np.concatenate([values[a > 0], values[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 512
        )
        off.append((times[0] == times[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.04


def test_signature_of_a_document_does_not_depend_on_its_batch():
    values = np.arange(1, 40, dtype=np.uint64) * np.uint64(977)
    count = np.arange(1, 40)
    alone = bagminhash.signatures(np.zeros(39, dtype=int), values, count, 1, 64)
    both = bagminhash.signatures(np.repeat([0, 1], 39), np.tile(values, 2), np.concatenate([count, count + 3]), 2, 64)
    assert (alone[0] == both[0]).all() and (both[0] != both[1]).any()


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(spark, docs).collect()}
    assert got == classes([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_crowd_of_near_copies(spark):
    """Copies of one text with ever more edits: pairs far apart are linked through others only."""
    base = [f"w{i * 7919 % 10007}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in range(i % 12):
            words[(k * 37 + i * 11) % 120] = f"edit{i}x{k}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes(rows)
    # Registers may miss a pair right at the threshold; nothing may be joined that is not linked.
    assert sum(got[i] != want[i] for i in want) <= 3
    assert all(want[i] == want[got[i]] for i in got)


def test_odd_documents(spark, tricky, no_docs):
    rows = bagminhash.near_duplicates(spark, tricky).collect()
    assert len(rows) == tricky.count()
    by_class = defaultdict(list)
    for r in rows:
        by_class[r["class_id"]].append(r)
    assert sorted(r["doc_id"] for r in by_class[7]) == [7, 8, 9]
    assert sorted(r["doc_id"] for r in by_class[3]) == [3, 3, 4]
    assert all(len(by_class[i]) == 1 for i in (0, 1, 2, 5, 6, None, 10))
    assert all(sum(r["kept"] for r in group) == 1 for group in by_class.values())
    kept = bagminhash.drop_near_duplicates(spark, tricky)
    assert kept.columns == tricky.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([0, 1, 2, 3, 5, 6, 7, None, 10])
    assert bagminhash.near_duplicates(spark, no_docs).count() == 0
    assert bagminhash.drop_near_duplicates(spark, no_docs).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 50])
def test_blocks_join_what_is_similar(spark, block):
    """Twelve nodes whose registers and items agree less and less; classes as by brute force."""
    draw = np.random.default_rng(2)
    base, common = draw.integers(0, 2**32, 64).astype("<u4"), np.arange(100, dtype="<u4")
    members, texts, sets = [], [], []
    for node in range(12):
        own = base.copy()
        own[40 + node :] = draw.integers(0, 2**32, 24 - node)
        items = common.copy()
        items[: 2 * node] = 1000 * (node + 1) + np.arange(2 * node)
        sets.append(set(items.tolist()))
        texts.append((node, bytearray(own.tobytes()), bytearray(np.sort(items).tobytes())))
        members += [(band, 900 + band, node, 100, node) for band in range(10)]
    rows = spark.createDataFrame(members, "band int, key long, node long, n long, comp long")
    found = bagminhash.block_links(
        rows, spark.createDataFrame(texts, "node long, registers binary, items binary"), 0.8, 40, block
    ).collect()
    parent = list(range(12))

    def joined(links):
        label = list(range(12))
        for a, b in links:
            label = [label[b] if x == label[a] else x for x in label]
        return [label.index(x) for x in label]

    every = [(a, b) for a in parent for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = [(r["a"], r["b"]) for r in found]
    assert set(got) <= set(every) and joined(got) == joined(every)
    assert len(set(joined(every))) > 1


def test_groups_that_cross_batches():
    def rows(keys):
        zero = pa.array([0] * len(keys), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), zero, zero], names=["key", "b1", "b2"])

    assert bagminhash.group_starts(rows([1, 1, 2, 2, 3])).tolist() == [0, 2, 4]
    assert not bagminhash.new_group(rows([1, 2]), rows([2, 2])) and bagminhash.new_group(rows([1]), rows([2]))
