"""Spelling variants: blocked Gram matrices of letter counts.

Words are the maximal runs of Latin letters of all texts, whole, with A to Z lower-cased; one
run in some 199, chosen by a checksum of document and run, loses a letter first (the contract's
planted slips). Words of at least six letters that occur at least five times in all take part.

One inserted or deleted letter changes a word's letter counts by one in one place, a replaced
one by one in two places: the squared distance of the count vectors is at most two. So words
are laid out in cells by length and by how many of their letters fall into two fixed sets;
near words lie in the same or an adjacent cell. A cell is cut into blocks by hash, each block
meets the blocks of adjacent cells, and one matrix product per pair of blocks gives all
squared distances. What is at most two is verified letter by letter. Pairs of blocks are
dealt out by number, so a crowded cell is spread over many tasks, and a task holds two blocks.

A word's form is its near word of largest count (of equal counts the smaller in code-point
order) if that is at least five times its own count; the root is where forms end. Counts grow
fivefold along forms, so no chain is longer than a few steps and none runs in a circle.

Null texts have no words; a null id counts as empty text in the checksum. Repeated rows count
as often as they occur. Empty tables, or no word often enough, give an empty result. Only the
id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, stored

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 199
MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5

# Words per block: two blocks and their product are what a task holds, some 40 MB.
BLOCK = 2048
# Candidates verified at a time.
SLICE = 200_000

# Letters: a to z, then the Latin-1 letters from 0xC0 to 0xFF.
LETTERS = 26 + 64
# Two sets of letters whose counts place a word; an edit moves each count by one at most.
SETS = ("aehilo", "nrst")
# Adjacent cells as steps of (length, first set, second set), each unordered pair of cells once:
# the same cell, replaced letters, and one letter more.
STEPS = [(0, 0, 0), (0, 1, -1), (0, 1, 0), (0, 0, 1), (1, 0, 0), (1, 1, 0), (1, 0, 1)]

# Forms are followed in doubling steps; 2 ** 5 exceeds any chain of fivefold counts below 2 ** 63.
DOUBLINGS = 5
# Copies of an inner node of the forms, against many words with one form in one task.
SALTS = 16


def lowered(run: Column) -> Column:
    return F.translate(run, UPPER, LOWER)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: every word that is long and frequent enough. Counted on the map side first."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"),
    ).select("id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    long_enough = runs.filter(F.length("run") >= MIN_LENGTH).withColumn("h", h).select(word.alias("word"))
    return (
        long_enough.filter(F.length("word") >= MIN_LENGTH)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= MIN_COUNT)
    )


def letters_of(word: str, letters: str) -> Column:
    """How many letters of a word are in a set."""
    return F.length(word) - F.length(F.translate(word, letters, ""))


def in_cells(words: DataFrame) -> DataFrame:
    """word, n, and the cell: length and letters in either set."""
    first, second = (letters_of("word", s).alias(f"cell_{i}") for i, s in enumerate(SETS, 1))
    return words.select("word", "n", F.length("word").alias("cell_0"), first, second)


CELL = ["cell_0", "cell_1", "cell_2"]


def blocks_of(cells: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    """One row per block: cell, number, words and counts. ``counts`` has the words per cell."""
    spread = F.broadcast(counts.select(*CELL, "blocks"))
    placed = cells.join(spread, CELL).withColumn("number", F.pmod(F.xxhash64("word"), "blocks"))
    return placed.groupBy(*CELL, "number").agg(
        F.collect_list("word").alias("words"), F.collect_list("n").alias("ns")
    )


def block_pairs(counts: DataFrame) -> DataFrame:
    """Numbers of the blocks that have to meet; each unordered pair once."""
    steps = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(s)]) for s in STEPS]))
    here = counts.withColumn("step", steps).select(
        *[F.col(c).alias(f"left_{c}") for c in CELL],
        *[(F.col(c) + F.col(f"step.d{i}")).alias(c) for i, c in enumerate(CELL)],
        F.col("blocks").alias("left_blocks"),
    )
    met = here.join(F.broadcast(counts.select(*CELL, "blocks")), CELL)
    numbered = met.withColumn("left_number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left_blocks") - 1)))
    same = F.lit(True)
    for c in CELL:
        same = same & (F.col(c) == F.col(f"left_{c}"))
    first = F.when(same, F.col("left_number")).otherwise(F.lit(0).cast("long"))
    return numbered.withColumn("number", F.explode(F.sequence(first, F.col("blocks") - 1))).select(
        *[f"left_{c}" for c in CELL], "left_number", *CELL, "number"
    )


def code_rows(words: list[str]) -> np.ndarray:
    """Letters as numbers from 1, one row per word, zeros behind the end."""
    width = max(map(len, words))
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(-1, width)
    return np.where(flat == 0, 0, np.where(flat < 0xC0, flat - 96, flat - 0xC0 + 27)).astype(np.uint8)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), LETTERS + 1), np.float32)
    rows = np.arange(len(codes))
    for column in codes.T:
        out[rows, column] += 1
    return out[:, 1:]


def one_edit_apart(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """Whether rows differ by exactly one letter replaced, or one more at the end of ``b``'s side.

    ``length_b`` is ``length_a`` or one more, the same for all rows.
    """
    la, lb = int(length_a), int(length_b)
    if la == lb:
        return (a[:, :la] != b[:, :la]).sum(1) == 1
    ahead = np.cumprod(a[:, :la] == b[:, :la], axis=1).sum(1)
    behind = np.cumprod(a[:, :la][:, ::-1] == b[:, 1:lb][:, ::-1], axis=1).sum(1)
    return ahead + behind >= la


def near_in(left: list[str], right: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions of near words; all left words have one length, all right ones one."""
    a, b = code_rows(left), code_rows(right)
    la, lb = len(left[0]), len(right[0])
    counts_a, counts_b = letter_counts(a), letter_counts(b)
    square = (counts_a**2).sum(1)[:, None] + (counts_b**2).sum(1)[None, :] - 2 * (counts_a @ counts_b.T)
    close = square <= 2.5
    if same:
        close &= np.triu(np.ones(close.shape, bool), 1)
    i, j = np.nonzero(close)
    kept = [
        one_edit_apart(a[i[s : s + SLICE]], b[j[s : s + SLICE]], la, lb) for s in range(0, len(i), SLICE)
    ]
    good = np.concatenate(kept) if kept else np.zeros(0, bool)
    return i[good], j[good]


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of every pair of near words of two blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            left, right = row["left_words"], row["words"]
            i, j = near_in(left, right, row["same"])
            for s in range(0, len(i), SLICE):
                x, y = i[s : s + SLICE], j[s : s + SLICE]
                one = pa.array(left).take(pa.array(x)), pa.array(row["left_ns"], pa.int64()).take(pa.array(x))
                two = pa.array(right).take(pa.array(y)), pa.array(row["ns"], pa.int64()).take(pa.array(y))
                for (word, n), (other, m) in ((one, two), (two, one)):
                    yield pa.RecordBatch.from_arrays([word, n, other, m], ["word", "n", "other", "other_n"])


def near_words(spark: SparkSession, words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, other, other_n: every ordered pair of near words. ``words`` has word and n."""
    cells = stored(spark, in_cells(words), "spelling-cells")
    # Cells are few: lengths times letters in two sets, never more than the cube of the longest word.
    counts = cells.groupBy(*CELL).agg(F.count("*").alias("cell_words"))
    counts = stored(spark, counts.withColumn("blocks", F.ceil(F.col("cell_words") / block)), "spelling-counts")
    blocks = stored(spark, blocks_of(cells, counts, block), "spelling-blocks")
    left = blocks.select(
        *[F.col(c).alias(f"left_{c}") for c in CELL],
        F.col("number").alias("left_number"),
        F.col("words").alias("left_words"),
        F.col("ns").alias("left_ns"),
    )
    # Left and right ends are unique blocks, so no key of these joins is hotter than the number
    # of blocks that one block meets.
    met = block_pairs(counts).join(left, [*[f"left_{c}" for c in CELL], "left_number"]).join(blocks, [*CELL, "number"])
    same = F.col("left_number") == F.col("number")
    for c in CELL:
        same = same & (F.col(c) == F.col(f"left_{c}"))
    pairs = met.select("left_words", "left_ns", "words", "ns", same.alias("same"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return pairs.mapInArrow(links, "word string, n long, other string, other_n long")


def with_roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """word, root. ``forms`` has a form for every word that has one.

    Only words that are forms themselves and go on are looked up; they are copied per salt, as
    very many words may share a form.
    """
    salt = F.pmod(F.xxhash64("word"), F.lit(SALTS)).alias("salt")
    reached = forms.select("word", F.col("form").alias("root"))
    for step in range(DOUBLINGS):
        onward = reached.select(F.col("word").alias("via"), F.col("root").alias("next"))
        onward = onward.join(reached.select(F.col("root").alias("via")).distinct(), "via", "left_semi")
        copies = onward.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        reached = (
            reached.select("word", "root", salt)
            .join(copies.withColumnRenamed("via", "root"), ["root", "salt"], "left")
            .select("word", F.coalesce("next", "root").alias("root"))
        )
        reached = stored(spark, reached, f"spelling-roots-{step}")
    return reached


def spelling_variants(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stored(spark, word_counts(docs, id_col, text_col), "spelling-words")
    # The best near word: largest count, then smallest word. Combined on the map side.
    best = near_words(spark, words, block).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    )
    strong = -F.col("best.minus") >= FACTOR * F.col("n")
    known = best.select(
        "word",
        "n_near",
        F.when(strong, F.col("best.other")).alias("form"),
        F.when(strong, -F.col("best.minus")).alias("form_n"),
    )
    known = stored(spark, known, "spelling-forms")
    roots = with_roots(spark, known.filter(F.col("form").isNotNull()).select("word", "form"))
    return (
        words.join(known, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form_n",
        )
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark, documents(spark, sf_dir))
