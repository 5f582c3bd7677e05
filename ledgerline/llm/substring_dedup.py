"""Repeated passages by sliding spans of sentences.

A text is cut behind marks and line ends. What is longer than 12 words is cut again, before each
word with the smallest hash of seven neighbours, so where a cut lies depends on the words around it
alone. A passage of over 50 words, with or without marks and wherever it is embedded, then shares
three whole pieces and 26 words or more with its copies: at most 12 words at its start and 13 at its
end merge with the text around. In scripts without spaces each character counts as a word.

Every run of three pieces is hashed. Runs are counted
over the whole corpus by the documents that hold them; the document with the smallest id keeps a run, the others lose the sentences that it covers. A
run that comes again within a document loses its later places. Covered stretches shorter
than 25 words stay, so common short phrases are left alone.

The pieces of a text joined give the text again, so what is returned is the text without the
removed pieces, unchanged otherwise. White space around a piece does not count when runs are
compared. Runs are compared by 64-bit hashes: among n runs about n**2 / 2**65 pairs agree by chance.

Null text counts as empty; empty texts and those of fewer pieces than a run, which have at most 24
words, lose nothing. Rows
that repeat an id are read as one document: what they share with each other stays. A null id
comes first. An empty table gives an empty result. Columns beside doc_id and text may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, stored

RUN = 3
LEAST_WORDS = 25
# Marks of Latin and Greek, Chinese and Japanese, Arabic, Indic, Armenian, Burmese, Khmer and Ethiopic texts.
MARKS = ".!?;:,\n" + "\u3002\uff0e\uff61\uff01\uff1f\uff1b\uff1a\uff0c\u3001\uff64" + "\u061f\u06d4\u060c\u061b" + "\u0964\u0965\u0589\u104a\u104b\u17d4\u17d5\u1362"
PIECE = re.compile(f"[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+")
# Thai, Lao, Burmese, Khmer, kana and Han: letters of words that no space parts.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED_LETTER = re.compile(f"[{UNSPACED}]")
WORD = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
# A passage of n words shares all but 4 * NEIGHBOURS - 3 or 2 * LONGEST words in whole pieces of at
# most LONGEST words: with 51 words three pieces and LEAST_WORDS remain.
LONGEST = 12
NEIGHBOURS = 7
NO_ID = -(2**63)


def count_words(text: str) -> int:
    if text.isascii() or not UNSPACED_LETTER.search(text):
        return len(text.split())
    return len(WORD.findall(text))


def shorter(piece: str) -> list[str]:
    """A long piece cut before each word whose hash is the first smallest of some seven neighbours."""
    words = WORD.findall(piece)
    hashes = [zlib.crc32(w.encode("utf-8", "replace")) for w in words]
    cuts, best = [], -1
    for at in range(len(hashes) - NEIGHBOURS + 1):
        end = at + NEIGHBOURS
        if best < at:  # the smallest has left: look at all seven, else only at the new one
            some = hashes[at:end]
            best = at + some.index(min(some))
            cuts.append(best)
        elif hashes[end - 1] < hashes[best]:
            best = end - 1
            cuts.append(best)
    out, place, start, done = [], 0, 0, 0
    for cut in cuts:
        for word in words[done : cut + 1]:
            place = piece.index(word, place) + len(word)
        done = cut + 1
        if cut:
            edge = place - len(words[cut])
            out.append(piece[start:edge])
            start = edge
    out.append(piece[start:])
    return out


def pieces(text: str | None) -> list[str]:
    out = []
    for piece in PIECE.findall(text or ""):
        if len(piece) > LONGEST and count_words(piece) > LONGEST:
            out += shorter(piece)
        else:
            out.append(piece)
    return out


def run_hashes(parts: list[str], run: int = RUN) -> np.ndarray:
    """The hash of every run of pieces, by its first piece."""
    if len(parts) < run:
        return np.zeros(0, dtype=np.int64)
    one = np.array([xxhash.xxh64_intdigest(p.strip().encode("utf-8", "replace")) for p in parts], dtype=np.uint64)
    total = np.zeros(len(parts) - run + 1, dtype=np.uint64)
    for k in range(run):
        total = (total ^ one[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """run, doc_id: every run of a document once, dealt by run.

    Counting and joining read the same shuffle, so texts are cut and hashed once for both. A run
    has one row per document that holds it, so it is a small share of all rows.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.unique(run_hashes(pieces(t), run)) for t in batch.column("text").to_pylist()]
            ids = np.repeat(batch.column("doc_id").to_numpy(), [len(x) for x in each])
            values = np.concatenate(each) if each else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(ids)], names=["run", "doc_id"])

    # Neither is ever null; said so, neither reader adds a filter that would tell its shuffle apart.
    return docs.mapInArrow(hashed, "run long not null, doc_id long not null").repartition("run")


def removed_pieces(parts: list[str], lost: set[int], run: int = RUN, least_words: int = LEAST_WORDS) -> np.ndarray:
    """Positions covered by lost runs, or by runs that came before, in stretches long enough."""
    hashes = run_hashes(parts, run)
    covered = np.zeros(len(parts), dtype=bool)
    _, first = np.unique(hashes, return_index=True)
    again = np.ones(len(hashes), dtype=bool)
    again[first] = False
    for start in np.nonzero(again | np.isin(hashes, np.fromiter(lost, np.int64, len(lost))))[0]:
        covered[start : start + run] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    for start, end in zip(edges[::2], edges[1::2]):
        if sum(count_words(p) for p in parts[start:end]) < least_words:
            covered[start:end] = False
    return np.flatnonzero(covered)


def drop_repeated_passages(
    spark: SparkSession, docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS
) -> DataFrame:
    """doc_id, pieces, removed (positions), removed_words, text: one row per row of the documents."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    found = runs(texts, run)
    shared = (
        found.groupBy("run")
        .agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        .filter("keeper <> last")
        .select("run", "keeper")
    )
    lost = stored(
        spark,
        found.join(shared, "run")
        .filter("doc_id <> keeper")
        .groupBy("doc_id")
        .agg(F.collect_list("run").alias("lost")),
        "lost-runs",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.string()]
        names = ["doc_id", "pieces", "removed", "removed_words", "text"]
        for batch in batches:
            rows = []
            for doc, text, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lost"))):
                parts = pieces(text)
                out = removed_pieces(parts, set(gone or ()), run, least_words).tolist()
                held = set(out)
                kept = "".join(p for i, p in enumerate(parts) if i not in held)
                words = sum(count_words(parts[i]) for i in out)
                rows.append((None if doc == NO_ID else doc, len(parts), out, words, kept))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    joined = texts.join(lost, "doc_id", "left").select("doc_id", "text", "lost")
    return joined.mapInArrow(cut, "doc_id long, pieces int, removed array<int>, removed_words long, text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(spark, documents(spark, sf_dir))
