from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import personal_data as pd_
from ledgerline.llm.catalog import QUERIES

RULES = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def checks(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == 1:
        return all(int(p) <= 255 for p in match.split("."))
    if kind == 2:
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def brute(text):
    return sorted(
        (m.start(), kind, m.end())
        for kind, rule in enumerate(RULES)
        for m in re.finditer(rule, text or "")
        if checks(kind, m[0])
    )


def as_text(spans):
    return ",".join(f"{pd_.KINDS[k]}:{a}:{b}" for a, k, b in spans)


CASES = [
    "a@b.c x@@y.z a@b@c.d e@f..g h@i.j.k. l.m%n+o-p@q-r.s- @t.u v@w @", "1.2.3.4.5.6.7.8 256.1.1.1 001.0000255.3.4 9999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 0000000000000000000 79927398713 378282246310005",
    "+1 (171) 555-2028 +12345678 +1234567890123456 +1+2 345 678 901 + 1 555 +9) (.- 12345678", "日本+81 3 1234 5678é@x.y", "", "+", "@",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_follow_the_rules(text):
    assert pd_.base_spans(text) == brute(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-() 01295é%", max_size=40))
def test_base_spans_of_any_text(text):
    assert pd_.base_spans(text) == brute(text)
    base, candidates = pd_.scanned(text)
    assert base == brute(text)
    for start, kind, end, known, free, features in candidates:
        assert 0 <= start < end <= len(text) and len(features) == 29
        assert free == all(b <= start or a >= end for a, _, b in base)


@pytest.mark.parametrize("text", ["x" * 300_000, "9" * 300_000, "1." * 150_000, "@" * 100_000, "+1 " * 100_000, "a.b at " * 40_000])
def test_long_monotonous_texts_take_no_long_time(text):
    base, _ = pd_.scanned(text)
    assert len(base) <= len(text)


def test_query_equals_brute_force_on_base_spans(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_personal_data"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pd_.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(as_text(base).encode()).hexdigest()
        every = [(int(a), pd_.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert every == sorted(every) and set(base) <= set(every)


def numbers(seed, n=400):
    """Cards with a cue before them, half of them mistyped, beside order numbers of other formats."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        digits = "".join(draw.choices("0123456789", k=15))
        check = next(c for c in "0123456789" if pd_.luhn(digits + c))
        wrong = i % 2
        number = digits + (str((int(check) + 1) % 10) if wrong else check)
        filler = " ".join(draw.choices(["lorem", "ipsum", "dolor", "sit"], k=12))
        decoy = "".join(draw.choices("0123456789abcdef", k=9)) + "".join(draw.choices("0123456789", k=13)) + "f"
        rows.append((i, f"{filler} {number} {filler} id={decoy}e {filler}", wrong, number))
    return rows


def test_trees_add_what_the_checksum_misses(spark):
    rows = numbers(3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pd_.personal_data(spark, docs).collect()}
    caught = 0
    for i, text, wrong, number in rows:
        spans = [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in got[i].split(",") if s)]
        caught += number in spans
        assert wrong or number in spans
        assert sum(len(s) for s in spans) < 80
    assert caught >= 0.95 * len(rows)


def test_odd_and_empty_documents(spark, tricky, no_docs):
    rows = pd_.personal_data(spark, tricky).collect()
    assert len(rows) == tricky.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["spans"] == "" and r["base_sha256"] == empty for r in rows)
    assert pd_.personal_data(spark, no_docs).count() == 0
    twice = spark.createDataFrame([(1, "a@b.c", 0), (1, "a@b.c", 1), (None, "a@b.c", 2)], "doc_id long, text string, kind int")
    assert [r["spans"] for r in pd_.personal_data(spark, twice).collect()] == ["email:0:5"] * 3


def test_redaction():
    assert pd_.redacted("mail a@b.c now", "email:5:10") == "mail [email] now"
    assert pd_.redacted(None, "") == ""
