from __future__ import annotations

import pytest

# Names that operators use inside, as columns of the input.
CLASHING = ["row_no", "size", "n", "key", "rank", "copies", "words", "mark", "score", "kept", "comp", "part"]

DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def doc(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), *CLASHING)


def long_text(words: int, salt: str = "w") -> str:
    return " ".join(f"{salt}{i * 7919 % 10007}" for i in range(words))


TRICKY = [
    doc(0, None),
    doc(1, "", None),
    doc(2, " \n\t "),
    doc(3, "alpha beta"),
    doc(3, "alpha beta"),
    doc(4, "alpha \n beta", "b"),
    doc(5, "x" * 150_000, "b"),
    doc(6, long_text(30_000), None),
    doc(7, long_text(400, "q")),
    doc(8, long_text(400, "q") + " end"),
    doc(9, long_text(400, "q"), "b"),
    doc(None, "a text without an id"),
    doc(10, "a  b\t\tc   d \n \n é ñ 日本 <|endoftext|> it's"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(TRICKY, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
