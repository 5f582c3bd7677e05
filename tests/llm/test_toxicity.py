from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from ledgerline.llm import toxicity
from ledgerline.llm.catalog import QUERIES

WORDS = [f"{a}{b}{c}" for a in ("be", "lo", "mi", "ta") for b in ("ra", "no", "ku", "se") for c in ("n", "ty", "m")]


def texts(n, bad, seed):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        words = draw.choices(WORDS, k=60)
        for _ in range(3 if bad else 0):
            # In place of a word: length must not tell the kinds apart.
            words[draw.randrange(60)] = draw.choice(["grumblefiend", "scoundrelish", "nastywort"])
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(texts(90, True, 1), texts(250, False, 2))


def test_scores_separate_unseen_texts(model):
    bad = toxicity.score_texts(model, texts(40, True, 3))
    good = toxicity.score_texts(model, texts(40, False, 4))
    assert (bad >= 0.5).mean() > 0.9 and (good < 0.5).mean() > 0.9


def test_whole_texts_count(model):
    """Toxic words behind a long ordinary text are found."""
    plain = " ".join(texts(30, False, 5))
    bad = " grumblefiend scoundrelish nastywort" * 4
    pair = toxicity.compressors(model.ordinary, model.toxic)
    ends = [toxicity.gains(pair, toxicity.windows(toxicity.plain(t), model.words)).max() for t in (plain, plain + bad)]
    assert ends[1] > ends[0]


def test_windows_cover_every_word():
    text = " ".join(f"w{i}" for i in range(101))
    content = toxicity.plain(text.replace("7", "x"))
    assert b" ".join(toxicity.windows(content, 8)).split() == content.split()
    assert toxicity.windows(toxicity.plain(None), 8) == toxicity.windows(toxicity.plain(" \n"), 8) == []


def test_equal_dictionaries_gain_nothing():
    pair = toxicity.compressors(b"some shared text", b"some shared text")
    assert not toxicity.gains(pair, toxicity.windows(b" some other shared text ", 2)).any()


def test_near_copies_teach_once():
    draw = random.Random(6)
    texts = [" ".join(draw.choices(WORDS, k=90)).encode() for _ in range(3)]
    assert toxicity.without_near_copies([*texts, texts[0] + b"end", texts[1]]) == texts


def test_telling_phrases_of_ordinary_words_are_found():
    """Neither word tells anything alone, both together do."""
    draw = random.Random(4)
    def some(pair):
        words = draw.choices(WORDS, k=30)
        words[draw.randrange(28)] = pair
        return f" {' '.join(words)} ".encode()
    bad = [some("bitter lemon") for _ in range(60)]
    good = [some(draw.choice(["bitter pill", "sour lemon"])) for _ in range(300)]
    telling = toxicity.telling_stretches(bad, good)
    assert all(any(b"r lem" in p for p in toxicity.telling_parts(t, telling)) for t in bad)


def stemmed(n, bad, seed):
    """Words of two to four syllables; toxic texts have up to three that begin with a stem of their own."""
    draw = random.Random(seed)
    syllables = ["be", "lo", "mi", "ta", "ra", "no", "ku", "se", "ty", "ven", "que", "dor"]
    out = []
    for _ in range(n):
        words = ["".join(draw.choices(syllables, k=draw.randint(2, 4))) for _ in range(60)]
        for _ in range(3 if bad else 0):
            words[draw.randrange(60)] = "vequ" + draw.choice(syllables)
        out.append(" ".join(words))
    return out


def test_short_stems_among_ordinary_words_are_caught():
    """The stem is as long as zstandard's cost of a match, and what follows it is ordinary."""
    model = toxicity.fit(stemmed(300, True, 1), stemmed(900, False, 2))
    bad = toxicity.score_texts(model, stemmed(150, True, 3))
    good = toxicity.score_texts(model, stemmed(150, False, 4))
    assert (bad >= 0.5).mean() > 0.8 and (good < 0.5).mean() > 0.95


def test_a_remembered_word_has_the_same_gain(model):
    _, pair, known = toxicity.prepared(model.ordinary, model.toxic)
    content = toxicity.plain(texts(1, True, 8)[0])
    first = toxicity.word_gains(pair, known, content)
    assert len(first) == 60 and known
    assert (toxicity.word_gains(pair, known, content) == first).all()
    assert (toxicity.word_gains(pair, {}, content) == first).all()


def test_odd_texts_get_a_score(spark, tricky, no_docs, model):
    rows = toxicity.score_documents(tricky, model).collect()
    assert len(rows) == tricky.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        known = r["doc_id"] is not None
        assert r["held_out"] == (known and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
    assert toxicity.score_documents(no_docs, model).count() == 0


def test_labels_odd_or_missing(spark, tricky, no_docs):
    labels = spark.createDataFrame(
        [(3, 1, 1), (3, 1, 0), (7, 1, 0), (None, 1, 1), (8, 1, None), (99, 0, 0)], "doc_id long, quality int, toxic int"
    )
    kept = toxicity.drop_toxic(tricky, labels)
    assert kept.columns == tricky.columns
    assert kept.count() <= tricky.count()
    assert toxicity.drop_toxic(no_docs, labels).count() == 0
    # Labels of one kind teach nothing: nothing is dropped.
    assert toxicity.fit_on_labels(tricky, labels.filter("toxic = 0")) is None
    assert toxicity.drop_toxic(tricky, labels.limit(0)).count() == tricky.count()


@pytest.fixture(scope="module")
def held_out(spark):
    """Score, label and language of the labelled documents that no fit has seen."""
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op1_toxicity"](spark, folder).filter("held_out")
    known = spark.read.parquet(f"{folder}/labels.parquet").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.join(known, "doc_id").select("score", "toxic", "lang").collect()
    return tuple(np.array([r[c] for r in rows]) for c in ("score", "toxic", "lang"))


def test_held_out_accuracy(held_out):
    score, label, _ = held_out
    order = np.argsort(np.argsort(score, kind="stable"))
    n = label.sum()
    auc = (order[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))
    assert auc > 0.95
    assert ((score >= 0.5) & (label == 0)).sum() <= 0.03 * (label == 0).sum()


def test_every_language_is_learned(held_out):
    """6 of the 97 toxic texts hold none of the words that mark the others; most of the rest are found."""
    score, label, lang = held_out
    recall = {k: ((score >= 0.5) & (label == 1) & (lang == k)).sum() / ((label == 1) & (lang == k)).sum() for k in set(lang)}
    assert len(recall) == 4 and min(recall.values()) > 0.6, recall
    assert ((score >= 0.5) & (label == 0)).sum() <= 0.03 * (label == 0).sum()
