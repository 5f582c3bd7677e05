from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import lexical_search as ls


def brute(docs, items):
    """Every document scored for every item."""
    held = [(i, Counter(ls.terms(t)), len(ls.terms(t))) for i, t in docs if ls.terms(t)]
    total, count = sum(n for *_, n in held), len(held)
    df = Counter(t for _, c, _ in held for t in c)
    texts: dict = {}
    for item, text in items:
        if item not in texts or (text is not None and (texts[item] is None or text < texts[item])):
            texts[item] = text
    rows = []
    for item, text in texts.items():
        found = []
        for doc_id, c, n in held:
            m = 75 + 25 * n * count // total
            score = sum(
                k * ls.weight(count, df[t]) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, k in Counter(ls.terms(text)).items()
                if t in c
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (minus, _, _, doc_id) in enumerate(sorted(found)[:20], 1):
            rows.append((item, rank, doc_id, -minus))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def invented(count, seed):
    """Many common words, copies in hundreds, ties and long texts."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.choice([3, 20, 80])))) for i in range(count)]
    docs += [(count + i, docs[5][1]) for i in range(count // 3)]
    items = [(i, " ".join(draw.choices(words, k=12))) for i in range(12)]
    return docs, [*items, (12, docs[5][1]), (13, "w0 w0 w0 w1"), (14, "absent")]


@pytest.mark.parametrize("tree", [50, 400, ls.TREE])
def test_search_equals_brute_force(spark, tree):
    docs, items = invented(900, 4)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(ls.lexical_search(spark, *frames, tree=tree)) == brute(docs, items)


def test_odd_documents_and_items(spark, tricky, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in tricky.collect()]
    items = [(0, "alpha BETA beta"), (0, "zzz"), (1, None), (2, ""), (None, "text id"), (3, "日本 é it s q7919"), (4, "endoftext")]
    frame = spark.createDataFrame([(*i, "x") for i in items], "item_id int, text string, n string")
    assert got(ls.lexical_search(spark, tricky, frame)) == brute(docs, items)
    assert ls.lexical_search(spark, no_docs, frame).count() == 0
    assert ls.lexical_search(spark, tricky, frame.limit(0)).count() == 0


def test_terms_are_cut_as_stated():
    assert ls.terms("It's ÉTÉ_x-9\x7fk 日本\n") == ["it", "s", "ÉtÉ", "x", "9", "k", "日本"]
    assert ls.terms(None) == ls.terms("") == ls.terms(" _!") == []


def test_bounds_hold_and_leave_documents_out():
    """No document below a node scores more than its bound, and most leaves are not read."""
    draw = np.random.default_rng(3)
    rows = sorted(tuple(sorted(set(draw.zipf(1.5, 15) % 500))) for _ in range(4000))
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    numbers = np.array([t for r in rows for t in r], np.int64)
    tree = ls.Tree(list(range(4000)), starts, numbers, draw.integers(1, 5, len(numbers)), draw.integers(75, 300, 4000))
    asked = np.zeros(600, np.int64)
    asked[[1, 40, 200, 333]] = [50, 3000, 5000, 6000]
    scores = tree.scores(0, 4000, asked)
    for node, (first, last) in enumerate(tree.span):
        assert tree.bound(node, asked) >= scores[first:last].max()
        assert not tree.children[node] or sorted(tree.span[c] for c in tree.children[node])[0][0] == first
    leaves = [s for s, c in zip(tree.span, tree.children) if not c]
    assert sorted(i for a, b in leaves for i in range(a, b)) == list(range(4000))
    read = []
    plain, tree.scores = tree.scores, lambda a, b, w: read.append((a, b)) or plain(a, b, w)
    best = tree.search(asked, [], 20)
    assert [-b[0] for b in best] == sorted(scores[scores > 0], reverse=True)[:20]
    assert len(read) < 0.6 * len(leaves)
