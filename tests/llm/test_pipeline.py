from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from ledgerline.llm.common import stored
from ledgerline.llm.packing import pieces
from ledgerline.llm.tokens import default_path


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage made of the stored result of the one before."""
    folder = "/root/testdata/sf0.01"
    out = [("documents", spark.read.parquet(f"{folder}/documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stored(spark, stage(spark, out[-1][1], folder), f"test-{name}")))
    return out


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_stages_keep_columns_and_invent_nothing(steps):
    columns = steps[0][1].columns
    rows = [None, *(df.select("doc_id", "text").collect() for _, df in steps[:-1])]
    for before, after, (_, df) in zip(rows[1:], rows[2:], steps[1:-1]):
        assert df.columns == columns
        assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_clean_documents_stay(steps):
    assert steps[1][1].count() >= 0.9 * steps[0][1].count()


def test_copies_go(steps):
    texts = [" ".join((r["text"] or "").split()) for r in steps[2][1].collect()]
    assert len(texts) == len(set(texts))
    assert steps[3][1].count() <= steps[2][1].count() < steps[1][1].count()


def test_mix_repeats_at_most_three_times(steps):
    copies = Counter(r["doc_id"] for r in steps[4][1].collect())
    assert max(copies.values()) <= 3


def test_packing_holds_every_copy(spark, steps):
    last = steps[5][1]
    want = Counter(tuple(r) for r in pieces(steps[4][1], default_path()).select("doc_id", "piece", "ids_crc32").collect())
    assert Counter(tuple(r) for r in last.select("doc_id", "piece", "ids_crc32").collect()) == want
    assert last.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[1:]])
def test_stages_take_odd_and_empty_documents(spark, tricky, no_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, tricky, "").count() > 0
    assert stage(spark, no_docs, "").count() == 0
