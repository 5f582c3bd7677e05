from __future__ import annotations

import re
from hashlib import sha256

import pytest

from ledgerline.llm.exact_dedup import drop_duplicates, frequent, mark_duplicates


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# All digests heavy, none heavy, and the split in use.
@pytest.mark.parametrize("support", [0.9, 0.0001, 0.2])
def test_marks_every_row(spark, tricky, support):
    got = [tuple(r) for r in mark_duplicates(spark, tricky, support=support).collect()]
    rows = [(r["doc_id"], normal(r["text"])) for r in tricky.collect()]
    assert len(got) == len(rows)
    for doc_id, keep_id, size, kept, digest in got:
        text = next(t for i, t in rows if sha256(t.encode()).hexdigest() == digest and i == doc_id)
        same = [i for i, t in rows if t == text]
        known = [i for i in same if i is not None]
        assert size == len(same) and keep_id == (min(known) if known else None)
    stay = [r[4] for r in got if r[3]]
    assert len(stay) == len(set(stay)) == len({t for _, t in rows})


@pytest.mark.parametrize("support", [0.9, 0.0001])
def test_drops_copies_and_keeps_columns(spark, tricky, support):
    got = drop_duplicates(spark, tricky, support=support)
    assert got.columns == tricky.columns
    rows = got.collect()
    assert len({normal(r["text"]) for r in rows}) == len(rows) == len({normal(r["text"]) for r in tricky.collect()})
    assert {r["doc_id"] for r in rows} == {0, 2, 3, 5, 6, 7, 8, None, 10}


def test_frequent_digests_are_found_and_counted(spark):
    rows = [(i, i, "hot" if i % 3 == 0 else f"d{i}") for i in range(3000)]
    found = frequent(spark.createDataFrame(rows, "doc_id long, row_no long, text_sha256 string"), 0.01).collect()
    assert len(found) <= 100
    assert {(r["win_id"], r["size"]) for r in found if r["text_sha256"] == "hot"} == {(0, 1000)}


def test_empty_table(spark, no_docs):
    assert mark_duplicates(spark, no_docs).count() == 0
    assert drop_duplicates(spark, no_docs).count() == 0
