"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, one from toxic and one from ordinary text. A
document is read whole, in windows of a few words; each window is compressed once with either
dictionary, and the bytes that the toxic one saves, as a share of the window, are its gain.
Each word is compressed alone as well, two bytes written for one: a match costs zstandard three to
four bytes whatever it stands for, which hides a short word or stem that only toxic texts use.
Gains of both kinds are put on a 0-to-1 scale by thresholds calibrated on labelled documents
that neither dictionary has seen.

Letters count, not their case or the marks around them: texts are lower-cased and runs of
marks and digits become one space. What goes into the toxic dictionary is chosen by contrast:
byte stretches of several lengths, across words too, that occur in so many more toxic than
ordinary texts that chance does not explain it (a likelihood ratio beyond the logarithm of
the number of stretches looked at); a longer one counts only where it holds no shorter one. No word list, language or share of texts enters, so a
language with few labelled texts is learned as well. Ordinary windows that gain without holding
such a stretch are fed back into the ordinary dictionary, toxic texts without a gain give their best window to the toxic
one. Near copies among the labelled texts count once. Settings are tried on halves of the
labelled texts, each scored by the other half, and the best one is trained on all.

Null and empty texts have no window and get the score of a document without gain. Documents
without a label, null labels and repeated ids are allowed; of differing labels of one id the
higher one counts. With labels of one kind only, nothing can be learned and every score is 0.
Where both dictionaries come out equal every gain is 0 and all scores are the same. Other
columns of the documents may have any name.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, process_cache, table

# The fit uses a bounded sample of labelled rows: so many of each kind, in order of a hash of
# the id, none longer than FIT_CHARS. Everything is scored, whole.
FIT_TOXIC = 1500
FIT_ORDINARY = 3000
FIT_CHARS = 20_000

FOLDS = 5

# Words per window, bytes of the toxic and of the ordinary dictionary.
SETTINGS = [(3, 16_384, 49_152)]
STRETCHES = (5, 6, 8, 10, 12)
ORDINARY_WINDOWS = 60_000
ROUNDS = 3
HARD_TEXTS = 800

# Bytes hashed at a time while stretches are counted: bounds what the driver holds.
CHUNK = 2_000_000

# Short matches count and the cheapest parse is looked for: windows are a few words long.
ZSTD = dict(
    window_log=17,
    chain_log=16,
    hash_log=14,
    search_log=3,
    min_match=3,
    target_length=64,
    strategy=zstandard.STRATEGY_BTOPT,
    write_content_size=False,
    write_checksum=False,
    write_dict_id=False,
)
# Words are looked for longer: most have occurred before and are remembered.
WORD_ZSTD = ZSTD | dict(window_log=18, chain_log=17, hash_log=16, search_log=5, target_length=16)
SECOND = bytes(i ^ 0x80 for i in range(256))
# Words remembered per process: a word's gain is the same wherever it stands.
KNOWN_WORDS = 300_000
BETWEEN = re.compile(r"[\W\d_]+")
CLEAR = (0.001, 0.05, 0.1, 0.15, 0.2, 0.3)
WORD_CLEAR = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)
TOP = 5


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration of their gains."""

    ordinary: bytes
    toxic: bytes
    words: int
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def plain(text: str | None) -> bytes:
    """Lower-case letters, one space between words and at both ends."""
    inner = BETWEEN.sub(" ", (text or "").lower()).strip()
    return f" {inner} ".encode("utf-8", "replace") if inner else b""


def windows(content: bytes, words: int) -> list[bytes]:
    """A whole plain text in windows of so many words."""
    parts = content.split()
    return [b" " + b" ".join(parts[i : i + words]) + b" " for i in range(0, len(parts), words)]


def compressor(content: bytes, how: dict = ZSTD) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(**how)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=settings)


def compressors(ordinary: bytes, toxic: bytes, how: dict = ZSTD) -> tuple:
    # zstandard refuses an empty dictionary; spaces compress nothing.
    return compressor(ordinary or b" " * 8, how), compressor(toxic or b" " * 8, how)


def doubled(content: bytes) -> bytes:
    """Each byte followed by another one that stands for the same."""
    out = bytearray(2 * len(content))
    out[0::2], out[1::2] = content, content.translate(SECOND)
    return bytes(out)


def prepared(ordinary: bytes, toxic: bytes) -> tuple:
    """Compressors of windows, compressors of single words, and the gains of words seen so far."""
    return compressors(ordinary, toxic), compressors(doubled(ordinary), doubled(toxic), WORD_ZSTD), {}


def gains(pair: tuple, parts: list[bytes]) -> np.ndarray:
    """Bytes the toxic dictionary saves against the ordinary one, per byte of the window."""
    ordinary, toxic = pair[0].compress, pair[1].compress
    return np.array([(len(ordinary(x)) - len(toxic(x))) / len(x) for x in parts], dtype=np.float64)


def word_gains(pair: tuple, known: dict[bytes, float], content: bytes) -> np.ndarray:
    """The gain of each word of a plain text by itself."""
    ordinary, toxic = pair[0].compress, pair[1].compress
    words = content.split()
    out = list(map(known.get, words))
    for i in [i for i, gain in enumerate(out) if gain is None]:
        part = doubled(b" " + words[i] + b" ")
        out[i] = (len(ordinary(part)) - len(toxic(part))) / len(part)
        if len(known) < KNOWN_WORDS:
            known[words[i]] = out[i]
    return np.array(out, dtype=np.float64)


def features(gain: np.ndarray, clear_from: tuple[float, ...] = CLEAR, lowest: float = -0.3) -> list[float]:
    """The largest gains, and how many windows and what share of them are clear."""
    top = np.full(TOP, lowest)
    best = np.sort(gain)[::-1][:TOP]
    top[: len(best)] = best
    out = [*top, float(top.sum())]
    for least in clear_from:
        clear = float((gain >= least).sum())
        out += [clear**0.5, clear / (len(gain) + 5)]
    saved = float(np.maximum(gain, 0).sum())
    return [*out, saved**0.5, saved / (len(gain) + 5), float(gain.mean()) if len(gain) else 0.0]


def described(tools: tuple, content: bytes, words: int) -> list[float]:
    """A plain text's figures: of its windows, then of its words."""
    pair, word_pair, known = tools
    by_word = word_gains(word_pair, known, content)
    return [*features(gains(pair, windows(content, words))), *features(by_word, WORD_CLEAR, 0.0)]


def score_texts(model: Model | None, texts: Iterable[str | None]) -> np.ndarray:
    texts = list(texts)
    if model is None or not texts:
        return np.zeros(len(texts))
    cache = process_cache("toxicity")
    if cache.get("model") != model:
        cache.update(model=model, tools=prepared(model.ordinary, model.toxic))
    rows = np.array([described(cache["tools"], plain(t), model.words) for t in texts])
    return probability(rows, model.mean, model.scale, model.weights)


def probability(rows: np.ndarray, mean, scale, weights) -> np.ndarray:
    # Summed row by row: a score must not depend on the rows beside it.
    z = ((rows - np.array(mean)) / np.array(scale) * np.array(weights[1:])).sum(axis=1) + weights[0]
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def stretch_hashes(content: bytes, length: int) -> np.ndarray:
    """A hash of each stretch of so many bytes."""
    data = np.frombuffer(content, dtype=np.uint8).astype(np.uint64)
    count = max(0, len(data) - length + 1)
    out = np.zeros(count, np.uint64)
    for j in range(length if count else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + data[j : j + count] + np.uint64(1)
    return out ^ (out >> np.uint64(29))


def without_near_copies(texts: list[bytes]) -> list[bytes]:
    """Texts of which at most half the stretches occur in the ones before."""
    seen: set[int] = set()
    out = []
    for text in texts:
        found = stretch_hashes(text, 12)
        sample = set(found[(found & np.uint64(15)) == 0].tolist())
        if len(sample) >= 4 and len(sample & seen) > 0.5 * len(sample):
            continue
        seen |= sample
        out.append(text)
    return out


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values occur among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def texts_with(texts: list[bytes], length: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stretches and in how many texts they occur; only the known ones, if given."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for part in chunks(texts):
        found = [np.unique(stretch_hashes(t, length)) for t in part]
        every = np.concatenate(found)
        if known is not None:
            every = every[among(every, known)]
        keys, at = np.unique(np.concatenate([keys, every]), return_inverse=True)
        weights = np.concatenate([counts, np.ones(len(every), np.int64)])
        counts = np.bincount(at, weights=weights, minlength=len(keys)).astype(np.int64)
    return keys, counts


def telling_stretches(toxic: list[bytes], ordinary: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length the stretches that toxic texts hold too often for chance, and the evidence of each."""
    out = {}
    for length in STRETCHES:
        keys, here = texts_with(toxic, length)
        tested = len(keys)
        keys, here = keys[here >= 3], here[here >= 3].astype(float)
        if not len(keys):
            continue
        found, n = texts_with(ordinary, length, keys)
        there = np.zeros(len(keys))
        there[np.searchsorted(keys, found)] = n
        share = len(toxic) / (len(toxic) + len(ordinary))
        both = here + there
        evidence = here * np.log(here / (both * share))
        evidence += there * np.log(np.maximum(there, 1e-9) / (both * (1 - share)))
        rate = (here + 0.5) / (len(toxic) + 1) / ((there + 0.5) / (len(ordinary) + 1))
        telling = (evidence >= np.log(tested)) & (rate >= 4)
        out[length] = (keys[telling], evidence[telling])
    return out


def telling_parts(text: bytes, telling: dict) -> set[bytes]:
    """Stretches of a text that telling ones cover, out to the next spaces (12 bytes at most)."""
    covered = np.zeros(len(text), bool)
    for length, (keys, _) in sorted(telling.items()):
        found = np.flatnonzero(among(stretch_hashes(text, length), keys))
        # Around a shorter stretch a longer one adds neighbours that tell nothing.
        before = np.concatenate([[0], np.cumsum(covered)])
        found = found[before[found + length] == before[found]]
        edges = np.zeros(len(text) + 1, np.int64)
        np.add.at(edges, found, 1)
        np.add.at(edges, found + length, -1)
        covered |= np.cumsum(edges)[:-1] > 0
    change = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int64), [0]])))
    parts = set()
    for start, end in zip(change[::2], change[1::2]):
        left = text.rfind(b" ", max(0, start - 12), start + 1)
        right = text.find(b" ", end - 1, end + 12)
        parts.add(text[left if left >= 0 else max(0, start - 12) : right + 1 if right >= 0 else end + 12])
    return parts


def trained(size: int, samples: list[bytes]) -> bytes:
    """Content of a trained dictionary; with too little text for training, the text itself."""
    if sum(map(len, samples)) > 10 * size and len(samples) > 20:
        try:
            return zstandard.train_dictionary(size, samples, k=64, d=6, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(
    toxic: list[bytes], ordinary: list[bytes], telling: dict, words: int, toxic_size: int, ordinary_size: int
) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary, hard windows of both kinds fed back."""
    parts_of = [telling_parts(text, telling) for text in toxic]
    common = Counter(part for parts in parts_of for part in parts)
    held = [part for part, _ in sorted(common.items(), key=lambda item: (item[1], item[0]))]
    draw = random.Random(11)
    every = [w for t in ordinary for w in windows(t, 8)]
    base = draw.sample(every, min(len(every), ORDINARY_WINDOWS))
    plain_part = trained(ordinary_size * 3 // 4, base)
    toxic_part = b"".join(held)[-toxic_size:]
    for _ in range(ROUNDS - 1):
        pair = compressors(plain_part, toxic_part)
        hard: list[bytes] = []
        for text in ordinary[:HARD_TEXTS]:
            parts = windows(text, words)
            gain = gains(pair, parts)
            best = [parts[i] for i in np.argsort(-gain, kind="stable")[:2] if gain[i] > 0.05]
            hard += [part for part in best if not telling_parts(part, telling)]
        plain_part = (plain_part + b"".join(dict.fromkeys(hard)))[-ordinary_size:]
        missed: set[bytes] = set()
        for text, parts in list(zip(toxic, parts_of))[:HARD_TEXTS]:
            if not (gains(pair, windows(text, words)) > 0).any():
                missed |= parts
        # The rarest stand first and fall out where room is short; missed ones move behind them.
        held = [*[p for p in held if p not in missed], *[p for p in held if p in missed]]
        toxic_part = b"".join(held)[-toxic_size:]
    return plain_part, toxic_part


def logistic(rows: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[tuple, tuple, tuple]:
    # A feature that never varies here says nothing and must not blow up elsewhere.
    mean, spread = rows.mean(0), rows.std(0)
    scale = np.where(spread > 1e-6, spread, 1.0)
    x = np.column_stack([np.ones(len(rows)), (rows - mean) / scale])
    weights = np.zeros(x.shape[1])
    # Features overlap: weights are held together, the constant is free.
    penalty = np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ weights, -40, 40)))
        slope = x.T @ (counts * (labels - p)) - penalty @ weights
        weights += np.linalg.solve(x.T @ (x * (counts * p * (1 - p))[:, None]) + penalty, slope)
    return tuple(mean), tuple(scale), tuple(weights)


def log_loss(p: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(counts * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / counts.sum())


def rows_of(ordinary: bytes, toxic: bytes, words: int, texts: list[bytes]) -> np.ndarray:
    tools = prepared(ordinary, toxic)
    return np.array([described(tools, t, words) for t in texts])


def fit(toxic: list[str], ordinary: list[str], share: float | None = None) -> Model | None:
    """The model from labelled texts, calibrated on texts its dictionaries did not see.

    Either half of the texts is scored with dictionaries of the other half; on these figures
    the calibration is fitted and the setting chosen, then its dictionaries are trained on all.
    ``share`` is how many of all labelled texts are toxic, where the given ones are a sample
    with another mix; the calibration weighs them accordingly.
    """
    bad = without_near_copies([t for t in dict.fromkeys(map(plain, toxic)) if t])
    good = without_near_copies([t for t in dict.fromkeys(map(plain, ordinary)) if t])
    if not bad or not good:
        return None
    share = len(bad) / (len(bad) + len(good)) if share is None else share

    halves = [(bad[0::2] or bad, good[0::2] or good), (bad[1::2] or bad, good[1::2] or good)]
    found = [telling_stretches(*half) for half in halves]
    best: tuple[float, tuple] = (np.inf, ())
    for words, toxic_size, ordinary_size in SETTINGS:
        rows, labels = [], []
        for half, telling, other in zip(halves, found, halves[::-1]):
            pair = dictionaries(*half, telling, words, toxic_size, ordinary_size)
            checked = other[1][:HARD_TEXTS]
            rows.append(rows_of(*pair, words, [*other[0], *checked]))
            labels += [1.0] * len(other[0]) + [0.0] * len(checked)
        every, kinds = np.concatenate(rows), np.array(labels)
        toxic_rows = kinds.sum()
        counts = np.where(kinds == 1, 1.0, toxic_rows * (1 - share) / share / (len(kinds) - toxic_rows))
        calibration = logistic(every, kinds, counts)
        loss = log_loss(probability(every, *calibration), kinds, counts)
        if loss < best[0]:
            best = (loss, (words, toxic_size, ordinary_size, calibration))
    words, toxic_size, ordinary_size, calibration = best[1]
    pair = dictionaries(bad, good, telling_stretches(bad, good), words, toxic_size, ordinary_size)
    return Model(*pair, words, *calibration)


def fold(id_col: str | Column = "doc_id") -> Column:
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % FOLDS, F.lit(1))


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from a bounded sample of labelled documents outside the held-out fold."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(fold() != 0)
    )
    kinds = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.filter("toxic = 1").orderBy(*order).limit(FIT_TOXIC).unionByName(
        known.filter("toxic = 0").orderBy(*order).limit(FIT_ORDINARY)
    )
    texts = (
        docs.select("doc_id", "text")
        .filter((F.length("text") > 0) & (F.length("text") <= FIT_CHARS))
        .join(F.broadcast(some), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
    )
    rows = sorted(texts.collect(), key=lambda r: r["doc_id"])
    random.Random(5).shuffle(rows)
    toxic, ordinary = ([r["text"] for r in rows if r["toxic"] == kind] for kind in (1, 0))
    return fit(toxic, ordinary, kinds if toxic and ordinary else None)


def scorer(model: Model | None):
    """A column function: text to score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(model, texts), dtype="float64")

    return score


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    return docs.select(
        "doc_id", (fold() == 0).alias("held_out"), scorer(model)("text").alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the model does not call toxic."""
    return docs.filter(scorer(fit_on_labels(docs, labels))("text") < 0.5)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return score_documents(docs, fit_on_labels(docs, labels))
