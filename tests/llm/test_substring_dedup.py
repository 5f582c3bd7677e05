from __future__ import annotations

import random
from collections import defaultdict

import pytest

from ledgerline.llm import substring_dedup as sub


def by_brute_force(docs, run=3, least=25):
    """Every run of every document in order of ids; the same rules, without hashes."""
    texts = [(i, sub.pieces(t)) for i, t in docs]
    keeper = defaultdict(set)
    for i, parts in texts:
        for at in range(len(parts) - run + 1):
            keeper[tuple(p.strip() for p in parts[at : at + run])].add(i)
    out = {}
    for i, parts in texts:
        seen, covered = set(), set()
        for at in range(len(parts) - run + 1):
            key = tuple(p.strip() for p in parts[at : at + run])
            if key in seen or min(keeper[key]) != i:
                covered.update(range(at, at + run))
            seen.add(key)
        lost, stretch = [], []
        for at in range(len(parts) + 1):
            if at in covered:
                stretch.append(at)
            else:
                if sum(len(parts[k].split()) for k in stretch) >= least:
                    lost += stretch
                stretch = []
        out[i] = (lost, "".join(p for k, p in enumerate(parts) if k not in set(lost)))
    return out


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["removed"], r["text"]) for r in sub.drop_repeated_passages(spark, docs).collect()}
    want = by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got == want and sum(bool(v[0]) for v in want.values()) > 10


def test_passage_goes_from_all_but_the_first(spark):
    passage = " ".join(f"This planted sentence has number {i} and some more words." for i in range(6))
    own = [" ".join(f"Document {d} says thing {i} in its own way." for i in range(5)) for d in range(40)]
    rows = [(d, f"{own[d]} {passage} {own[d][::-1]}") for d in range(40)]
    rows.append((40, own[0].upper()))
    got = {r["doc_id"]: r for r in sub.drop_repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["removed"] == [] and got[0]["text"] == rows[0][1] and got[40]["removed"] == []
    for d in range(1, 40):
        assert "number 3" not in got[d]["text"] and own[d] in got[d]["text"]


def test_pieces_give_the_text_again():
    for text in ("", "a", "a. b! c?\n\nd, e", "...", "\n\n", "no end", "é。 x: y; z"):
        assert "".join(sub.pieces(text)) == text
    assert sub.pieces(None) == []


def test_repeats_within_a_document():
    line = "one two three four five six seven eight nine ten. "
    parts = sub.pieces(line * 8)
    assert sub.removed_pieces(parts, set()).tolist() == list(range(1, 8))


def test_odd_documents(spark, tricky, no_docs):
    rows = sub.drop_repeated_passages(spark, tricky).collect()
    assert len(rows) == tricky.count()
    assert {r["text"] for r in rows if r["doc_id"] in (0, 1)} == {""}
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in tricky.collect()}
    assert sub.drop_repeated_passages(spark, no_docs).count() == 0


LATIN = [f"{a}{b}{c}" for a in ("be", "lo", "mi", "ta", "sur") for b in ("ra", "no", "ku") for c in ("n", "ty", "m", "st")]
HAN = [chr(0x4E00 + 37 * i) for i in range(400)]


def embedded(kind, seed):
    """A passage of 51 words, or characters, in the middle of sentences of two texts, and the texts."""
    draw = random.Random(f"{kind} {seed}")
    if kind == "han":
        words, space, marks = HAN, "", ["", "\u3002", "\uff0c"]
    else:
        words, space, marks = LATIN, " ", [""] if kind == "unpunctuated" else ["", ".", ","]
    some = draw.choices(words, k=51)
    if kind == "two sentences":
        some[draw.randrange(10, 40)] += "."
    elif kind != "unpunctuated":
        for at in range(draw.randrange(1, 14), 51, draw.randrange(5, 14)):
            some[at] += draw.choice(marks)
    passage = space.join(some)
    texts = []
    for _ in range(2):
        before, after = (space.join(draw.choices(words, k=draw.randrange(1, 40))) for _ in range(2))
        texts.append(before + space + passage + space + after)
    return texts


@pytest.mark.parametrize("kind", ["unpunctuated", "two sentences", "mixed", "han"])
def test_any_passage_of_over_50_words_is_found(kind):
    for seed in range(300):
        first, second = (sub.pieces(t) for t in embedded(kind, seed))
        lost = set(sub.run_hashes(first).tolist())
        out = sub.removed_pieces(second, lost).tolist()
        assert sum(sub.count_words(second[i]) for i in out) >= 25, seed
        assert "".join(second[i] for i in out) in "".join(first)


def test_unmarked_passages_go_from_the_later_document(spark):
    rows, kinds = [], ["unpunctuated", "two sentences", "mixed", "han"]
    for i, kind in enumerate(kinds):
        rows += [(10 * i + n, t) for n, t in enumerate(embedded(kind, 1000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in sub.drop_repeated_passages(spark, docs).collect()}
    for i in range(len(kinds)):
        assert got[10 * i]["removed_words"] == 0 and got[10 * i + 1]["removed_words"] >= 25


def test_pieces_of_any_script_give_the_text_again():
    for kind in ("unpunctuated", "han"):
        for text in embedded(kind, 0):
            assert "".join(sub.pieces(text + "  \n ")) == text + "  \n "
            assert max(sub.count_words(p) for p in sub.pieces(text)) <= sub.LONGEST


def test_texts_are_hashed_once(spark):
    """Counting and joining read one shuffle of the runs."""
    import pyspark.sql.functions as F

    from ledgerline.llm import substring_dedup as sd

    found = sd.runs(spark.createDataFrame([(i, " ".join(f"w{j}." for j in range(9))) for i in range(4)], "doc_id long, text string"))
    counted = found.groupBy("run").agg(F.min("doc_id").alias("keeper"))
    joined = found.join(counted, "run").filter("doc_id <> keeper")
    assert joined.count() == 21
    joined.collect()
    assert "ReusedExchange" in joined._jdf.queryExecution().executedPlan().toString()


def test_cuts_are_at_the_first_smallest_of_seven():
    import random
    import zlib

    from ledgerline.llm import substring_dedup as sd

    rng = random.Random(3)
    for size in [13, 14, 40, 200]:
        for words in (["a", "aa", "b"], [f"w{i}" for i in range(50)], ["一", "x", "あ"]):
            piece = " ".join(rng.choice(words) for _ in range(size))
            found = [(m.start(), zlib.crc32(m[0].encode())) for m in sd.WORD.finditer(piece)]
            cuts = {min(range(at, at + 7), key=lambda i: (found[i][1], i)) for at in range(len(found) - 6)}
            edges = [0, *(found[c][0] for c in sorted(cuts - {0})), len(piece)]
            assert sd.shorter(piece) == [piece[a:b] for a, b in zip(edges, edges[1:])]
