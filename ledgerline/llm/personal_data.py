"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Every text is read whole. Four rules give the base spans, leftmost and without overlap inside
a kind: emails, addresses of four numbers up to 255, card numbers of 12 to 19 digits that pass
the Luhn check, and phone numbers of 9 to 15 digits behind a plus sign. Generators of high
recall propose overlapping spans besides: digit groups with any separators, runs of digits
alone, chains of four and more numbers, whatever stands around an at-sign or a spelled-out one.

A candidate that all but coincides with a base span of its kind is a known case, the others
are unknown, not wrong: a mistyped card number fails the checksum and is still one. Boosted
trees learn to tell known cases from format and context alone; what the rules test (checksum,
plus sign, size of numbers) is no input. The share of known cases that trees give to a kind's
own known cases, measured over all held-out documents, calibrates them: a candidate is as
likely personal as its score is against that figure, and half of it is the kind's threshold.
Kinds with fewer than MIN_KNOWN held-out cases get no spans added. Of overlapping candidates the
one with the higher score stays, then the earlier, then the longer; base spans always stay.

The trees are fitted on a bounded sample, at most FIT candidates of each class in order of a hash,
outside the held-out fold of documents; all else covers every document.

Null counts as empty. Repeated rows are scanned each on its own; a null id belongs to the
fitting fold. An empty table gives an empty result, texts without candidates empty span lists.
Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, empty_if_null, stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base rules, as the contract states them; written so that no text makes them go back far.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
FOUR = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The generators.
ANY_DIGITS = re.compile(r"\(?(?<![0-9])[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}")
ONLY_DIGITS = re.compile(r"[0-9]{7,}")
CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
SPELLED = re.compile(
    r"(?<![\w.%+-])[\w.%+-]++\s?[\[({]?\s?(?:at|AT)\s?[\])}]?\s?[\w-]++(?:\s?[\[({]?\s?(?:dot|DOT|\.)\s?[\])}]?\s?[\w-]++)+"
)

FOLDS = 5
FIT = 10_000
ROUNDS = 20
DEPTH = 4
MIN_KNOWN = 20
# A candidate that shares so much of its length with a base span is that span.
SAME = 0.75
CONTEXT = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Local part, at-sign, domain with a dot. The part before the sign starts behind the last match."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        else:
            # No later start may reach back over this sign.
            end = at + 1
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, by start and kind."""
    spans = [(a, EMAIL, b) for a, b in emails(text)]
    for m in FOUR.finditer(text):
        if all(len(p) <= 3 or not p[:-3].strip("0") for p in m[0].split(".")) and all(
            int(p[-3:]) <= 255 for p in m[0].split(".")
        ):
            spans.append((m.start(), IP, m.end()))
    for m in GROUPED.finditer(text):
        digits = only_digits(m[0]) if len(m[0]) <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), CARD, m.end()))
    for m in DIALLED.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            spans.append((m.start(), PHONE, m.end()))
    return sorted(spans)


def proposals(text: str) -> set[tuple[int, int, int]]:
    """(start, kind, end) of whatever may be personal; spans overlap."""
    found = set()
    for m in ANY_DIGITS.finditer(text):
        digits = sum("0" <= c <= "9" for c in m[0])
        if 12 <= digits <= 19:
            found.add((m.start(), CARD, m.end()))
        if 7 <= digits <= 15:
            found.add((m.start(), PHONE, m.end()))
    for m in ONLY_DIGITS.finditer(text):
        size = m.end() - m.start()
        if 12 <= size <= 19:
            found.add((m.start(), CARD, m.end()))
        if size <= 15:
            found.add((m.start(), PHONE, m.end()))
    for m in CHAIN.finditer(text):
        found.add((m.start(), IP, m.end()))
        four = FOUR.match(text, m.start())
        found.add((m.start(), IP, four.end()))
    at = text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > 0 and at - start < 64 and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and end - at < 255 and not text[end].isspace():
            end += 1
        if end - start > 3:
            found.add((start, EMAIL, end))
        at = text.find("@", at + 1)
    found |= {(m.start(), EMAIL, m.end()) for m in SPELLED.finditer(text)}
    return found


def char_class(text: str, at: int) -> int:
    if not 0 <= at < len(text) or text[at] in "\r\n":
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def share(part: str, test) -> float:
    return sum(map(test, part)) / len(part) if part else 0.0


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of a span and what stands around it."""
    span = text[start:end]
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    # The sign before a phone number is what its rule tests: look past it.
    before = start - 1 if start and text[start - 1] == "+" else start
    left, right = text[max(0, before - CONTEXT) : before], text[end : end + CONTEXT]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        float(sum(groups)),
        float(len(span)),
        float(len(groups)),
        float(max(groups)),
        float(min(groups)),
        float(groups[0]),
        float(groups[-1]),
        float(len(set(only_digits(span)))),
        *(float(span.count(c)) for c in " -./("),
        share(span, str.isalpha),
        float(span[0] == "0"),
        float(char_class(text, before - 1)),
        float(char_class(text, before - 2)),
        float(char_class(text, end)),
        float(char_class(text, end + 1)),
        share(left, str.isalpha),
        share(left, str.isdigit),
        share(right, str.isalpha),
        share(right, str.isdigit),
        float(any(c in left[-4:] for c in "=:\"'#")),
        float(left.count("|") + right.count("|")),
    ]


def scanned(text: str) -> tuple[list, list]:
    """Base spans, and candidates as (start, kind, end, known, free, features)."""
    if not text:
        return [], []
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    reach, furthest = [], 0
    for _, _, end in base:
        furthest = max(furthest, end)
        reach.append(furthest)
    out = []
    for start, kind, end in sorted(proposals(text)):
        known, free = False, True
        i = bisect_right(starts, end - 1) - 1
        while i >= 0 and reach[i] > start:
            a, k, b = base[i]
            both = min(b, end) - max(a, start)
            free &= both <= 0
            known |= k == kind and both >= SAME * (max(b, end) - min(a, start))
            i -= 1
        out.append((start, kind, end, known, free, features(text, start, kind, end)))
    return base, out


SPAN = "struct<start:long,kind:int,end:long>"
SPAN_TYPE = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
CANDIDATE = "struct<start:long,kind:int,end:long,known:boolean,free:boolean,features:array<double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_no, doc_id, base, candidates: one row per document, one pass over the texts."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id_col).alias("doc_id"),
        empty_if_null(text_col).alias("text"),
    )
    span = SPAN_TYPE
    candidate = pa.struct([*span, ("known", pa.bool_()), ("free", pa.bool_()), ("features", pa.list_(pa.float64()))])
    names, more = [f.name for f in span], [f.name for f in candidate]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanned(t.as_py()) for t in batch.column("text")]
            base = [[dict(zip(names, s)) for s in spans] for spans, _ in found]
            others = [[dict(zip(more, c)) for c in candidates] for _, candidates in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_no"), batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(others, pa.list_(candidate))],
                ["row_no", "doc_id", "base", "candidates"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"row_no long, doc_id {kind}, base array<{SPAN}>, candidates array<{CANDIDATE}>")


def fold() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(1))


def fit(candidates: DataFrame) -> GBTClassificationModel | None:
    """Trees that tell known candidates from unknown ones; none without both."""
    order = [F.xxhash64("row_no", "start", "kind", "end"), "row_no", "start", "kind", "end"]
    pool = candidates.filter(fold() != 0)
    sample = pool.filter("known").orderBy(*order).limit(FIT).unionByName(pool.filter("not known").orderBy(*order).limit(FIT))
    ready = sample.select(F.col("known").cast("double").alias("label"), array_to_vector("features").alias("vector"))
    # A few thousand short rows: one partition keeps the many small passes over them short.
    ready = ready.coalesce(1).cache()
    try:
        if len(ready.select("label").distinct().collect()) < 2:
            return None
        trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=7)
        return trees.fit(ready)
    finally:
        ready.unpersist()


def scored(candidates: DataFrame, model: GBTClassificationModel) -> DataFrame:
    vectors = candidates.withColumn("vector", array_to_vector("features"))
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1])


def thresholds(candidates: DataFrame, model: GBTClassificationModel) -> dict[int, float]:
    """Half of the mean score of a kind's known cases in the held-out documents; four rows come back."""
    held_out = scored(candidates.filter((fold() == 0) & F.col("known")), model)
    rows = held_out.groupBy("kind").agg(F.avg("score").alias("mean"), F.count("*").alias("n")).collect()
    return {r["kind"]: r["mean"] / 2 for r in rows if r["n"] >= MIN_KNOWN}


def without_overlap(spans: list[dict]) -> list[dict]:
    """Of overlapping candidates of one text the better one."""
    starts: list[int] = []
    held: list[dict] = []
    for s in sorted(spans, key=lambda s: (-s["score"], s["start"], -s["end"], s["kind"])):
        i = bisect_right(starts, s["start"])
        if (i and held[i - 1]["end"] > s["start"]) or (i < len(held) and held[i]["start"] < s["end"]):
            continue
        starts.insert(i, s["start"])
        held.insert(i, {name: s[name] for name in ("start", "kind", "end")})
    return held


def chosen_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [without_overlap(spans) for spans in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row_no"), pa.array(lists, pa.list_(SPAN_TYPE))], ["row_no", "added"])


def added_spans(candidates: DataFrame, model: GBTClassificationModel, least: dict[int, float]) -> DataFrame:
    """row_no, added: spans beyond the base ones. A group is the candidates of one document."""
    enough = F.lit(False)
    for kind, threshold in least.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("score") >= threshold))
    chosen = scored(candidates.filter("free"), model).filter(enough)
    lists = chosen.groupBy("row_no").agg(F.collect_list(F.struct("start", "kind", "end", "score")).alias("spans"))
    return lists.mapInArrow(chosen_spans, f"row_no long, added array<{SPAN}>")


def as_text(spans: Column) -> Column:
    """kind:start:end of spans in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def personal_data(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    rows = stored(spark, scan(docs, id_col, text_col), "personal-data")
    candidates = rows.select("row_no", "doc_id", F.inline("candidates"))
    model = fit(candidates)
    least = thresholds(candidates, model) if model else {}
    marked = rows.drop("candidates").withColumn("added", F.lit(None).cast(f"array<{SPAN}>"))
    if least:
        marked = rows.drop("candidates").join(added_spans(candidates, model, least), "row_no", "left")
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    nothing = F.array().cast(f"array<{SPAN}>")
    return marked.select(
        "doc_id",
        *count,
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.concat("base", F.coalesce("added", nothing))).alias("spans"),
    )


def redacted(text: str | None, spans: str) -> str:
    """A text with its spans, as returned, replaced by their kinds; of overlapping ones the first."""
    out, at = [], 0
    for kind, start, end in (s.split(":") for s in spans.split(",") if s):
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
            at = int(end)
    return "".join([*out, (text or "")[at:]])


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark, documents(spark, sf_dir))
