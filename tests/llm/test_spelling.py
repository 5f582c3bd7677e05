from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import spelling
from ledgerline.llm.catalog import QUERIES

A_Z = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(A_Z)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def brute(docs):
    """Near words by the patterns they share: a gap in place of one letter."""
    count = counted(docs)
    gaps, near = defaultdict(set), defaultdict(set)
    for w in count:
        for i in range(len(w)):
            gaps["replaced", w[:i], w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in count:
                near[w].add(short)
                near[short].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in count.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-count[x], x))
            if count[best] >= 5 * n:
                form[w] = best
    rows = set()
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, len(near[w]), count[form[w]] if w in form else None))
    return rows


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(docs)
    assert got(QUERIES["op11_spelling_variants"](spark, folder)) == want
    assert len(want) > 1000 and any(r[1] for r in want)


def family(spark):
    """Chains of forms, ties, inserted and replaced letters, accents, and words just out of reach."""
    counts = {
        "receive": 200, "recieve": 6, "receve": 30, "receves": 5, "receivex": 200, "Receives": 40,
        "château": 60, "chateau": 5, "châteaux": 12, "abcdef": 5, "bcdefa": 5, "abcdeg": 25, "abcdez": 25,
        "tiny": 500, "seldom": 4, "aaaaaa": 7, "aaaaaaa": 35, "aaaaaaaa": 175,
    }
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    rows += [(None, None), (77, ""), (78, "12 34 ÷×"), (79, "é" * 3), (3, "abcdef"), (3, "abcdef")]
    return rows


def test_small_blocks_lose_nothing(spark):
    rows = family(spark)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    for block in (1, 3, 2048):
        assert got(spelling.spelling_variants(spark, docs, block=block)) == brute(rows)


def test_odd_and_empty_documents(spark, tricky, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in tricky.collect()]
    assert got(spelling.spelling_variants(spark, tricky)) == brute(rows)
    assert spelling.spelling_variants(spark, no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", min_size=6, max_size=6), min_size=1, max_size=25, unique=True),
       st.lists(st.text("abé", min_size=7, max_size=7), min_size=1, max_size=25, unique=True))
def test_products_find_every_near_pair(short, long):
    i, j = spelling.near_in(short, long, False)
    assert {(short[x], long[y]) for x, y in zip(i, j)} == {
        (a, b) for a in short for b in long if any(b[:k] + b[k + 1 :] == a for k in range(7))
    }
    i, j = spelling.near_in(short, short, True)
    assert {frozenset((short[x], short[y])) for x, y in zip(i, j)} == {
        frozenset((a, b)) for a in short for b in short if sum(p != q for p, q in zip(a, b)) == 1
    }


def test_a_crowded_cell_is_dealt_out(spark):
    words = spark.range(3000).selectExpr("concat('aaaaaa', lpad(conv(id, 10, 16), 4, 'g')) word", "id + 5 n")
    cells = spelling.in_cells(words)
    counts = cells.groupBy(*spelling.CELL).count().selectExpr(*spelling.CELL, "ceil(count / 100) blocks")
    sizes = spelling.blocks_of(cells, counts, 100).selectExpr("size(words) s").collect()
    assert max(r["s"] for r in sizes) <= 200 and sum(r["s"] for r in sizes) == 3000
