"""The raw layer: nested JSON batches, read back with the order they were written in.

A file is a JSON array of payloads or a single payload. Two layouts exist:

* ``"lines"``: one JSON value per line, what ``sinks.raw`` writes.
* ``"array"``: the whole file is one JSON value, indented or not.

Files of both layouts split across tasks. An array is cut at its closing braces, and running
sums of quotes and braces, which splits hand over to each other, tell which pieces make up a
payload (``array_values``); what one task holds is a split or a payload, never a file.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.series import running_sums
from ledgerline.schemas import RAW_PAYLOADS

LINEAGE = "lineage"
_SCHEME = r"^[a-zA-Z0-9]+:/*"
_TEXT_SCHEMA = "value string"


def _bare(path: str) -> str:
    return re.sub(_SCHEME, "/", path).rstrip("/") + "/"


def path_order(path: str) -> Column:
    """Text that sorts like the list of path components.

    Plain text order would put ``a-b/c`` before ``a/c``; a separator below every other
    character compares component by component.
    """
    return F.translate(path, "/", "\u0001")


def with_source(lines: DataFrame, ordinal: int) -> DataFrame:
    """Add where a line came from. Line numbers only need to be ordered inside one split."""
    return lines.select(
        F.regexp_replace("value", "^\uFEFF", "").alias("value"),
        F.col("_metadata.file_path").alias("file_path"),
        F.lit(ordinal).alias("root"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("line"),
    )


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def array_values(pieces: DataFrame) -> DataFrame:
    """Payloads of files that are one JSON value, from pieces that end before a closing brace.

    Quotes outside of escapes say which pieces begin inside a string; braces outside of
    strings say how deep a piece ends; a piece that ends at depth zero ends a payload. All
    three are running sums along a file, made per split and carried over splits. Every
    payload is a row, numbered along its file in ``line``. What holds no payload but is more
    than brackets and commas stays as it is, to be reported as unreadable.
    """
    keys, order = ["file_path", "root"], [F.col("line")]

    def carried(rows: DataFrame, out: str, value: Column) -> DataFrame:
        return running_sums(rows, keys, order, "split_start", {out: value})

    # No escape of JSON ends in a brace, so none is cut in two.
    bare = F.regexp_replace("value", r"\\.", "")
    quoted = carried(pieces.withColumn("_quotes", _count(bare, '"')), "_upto", F.col("_quotes"))
    inside = (F.col("_upto") - F.col("_quotes")) % 2 == 1
    ends_inside = F.col("_upto") % 2 == 1
    after = F.when(inside, F.regexp_replace(bare, r'^[^"]*"?', "")).otherwise(bare)
    outside = F.regexp_replace(after, r'"[^"]*("|$)', "")
    change = _count(outside, "{") - F.when(ends_inside, 0).otherwise(1)
    deep = carried(quoted.withColumn("_change", change), "_depth", F.col("_change"))
    closes = (F.col("_depth") == 0) & ~ends_inside
    numbered = carried(deep.withColumn("_closes", closes.cast("int")), "_closed", F.col("_closes"))
    text = F.concat("value", F.lit("}"))
    parts = F.array_sort(F.collect_list(F.struct("split_start", "line", text.alias("text"))))
    whole = F.array_join(F.transform(parts, lambda x: x["text"]), "")
    values = numbered.groupBy(*keys, (F.col("_closed") - F.col("_closes")).alias("line")).agg(
        whole.alias("value"), F.max("_closes").alias("_ended")
    )
    # A payload that never ends is not to be read in part.
    broken = (F.col("_ended") == 0) & F.col("value").contains("{")
    values = values.withColumn("value", F.when(broken, F.concat(F.lit("no end: "), "value")).otherwise(F.col("value")))
    # Between payloads stand brackets, commas, white space and a byte order mark. Behind the last
    # one the same is left, at depth -1, with the brace that was put behind every piece.
    return values.select(
        F.regexp_replace("value", "^[\\[\\],\\s\uFEFF]+", "").alias("value"),
        "file_path",
        "root",
        F.lit(0).cast("long").alias("split_start"),
        "line",
    ).filter(F.col("value") != "}")


def _read_array(spark: SparkSession, root: str, ordinal: int, pattern: str) -> DataFrame:
    """Pieces of the files under a root, cut at closing braces by the text reader."""
    pieces = (
        spark.read.schema(_TEXT_SCHEMA)
        .option("lineSep", "}")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .format("text")
        .load(root)
    )
    return with_source(pieces, ordinal)


def _read_root(spark: SparkSession, root: str, ordinal: int, layout: str, pattern: str) -> DataFrame | None:
    try:
        if layout == "array":
            return array_values(_read_array(spark, root, ordinal, pattern))
        lines = (
            spark.read.schema(_TEXT_SCHEMA)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .format("text")
            .load(root)
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return with_source(lines, ordinal)


def entries_of(lines: DataFrame) -> DataFrame:
    """One row per payload: metadata, records, and its place in reading order."""
    parsed = lines.withColumn("_payloads", F.from_json("value", RAW_PAYLOADS)).filter(
        F.trim("value") != ""
    )
    return parsed.select(
        "file_path",
        "root",
        "split_start",
        "line",
        F.posexplode_outer("_payloads").alias("entry", "_payload"),
    ).select(
        "file_path",
        F.struct(
            "root",
            path_order("file_path").alias("path"),
            "split_start",
            "line",
            "entry",
        ).alias(LINEAGE),
        F.col("_payload").isNull().alias("unreadable"),
        F.col("_payload.metadata").alias("metadata"),
        F.coalesce("_payload.records", F.array().cast(RAW_PAYLOADS.elementType["records"].dataType)).alias("records"),
    )


def read_lines(
    spark: SparkSession, roots: list[str], layouts: list[str] | str = "lines", pattern: str = "*.json"
) -> DataFrame:
    """Lines of several roots; earlier roots first. Missing roots are skipped.

    A file reachable through two roots belongs to the first of them.
    """
    if isinstance(layouts, str):
        layouts = [layouts] * len(roots)
    found: list[DataFrame] = []
    for ordinal, (root, layout) in enumerate(zip(roots, layouts)):
        lines = _read_root(spark, root, ordinal, layout, pattern)
        if lines is None:
            continue
        bare = F.regexp_replace("file_path", _SCHEME, "/")
        for earlier in roots[:ordinal]:
            if _bare(root).startswith(_bare(earlier)) or _bare(earlier).startswith(_bare(root)):
                lines = lines.filter(~bare.startswith(_bare(earlier)))
        found.append(lines)
    if not found:
        raise FileNotFoundError(f"no raw files under {roots}")
    union = found[0]
    for lines in found[1:]:
        union = union.unionByName(lines)
    return union


def read_entries(
    spark: SparkSession, roots: list[str], layouts: list[str] | str = "lines", pattern: str = "*.json"
) -> DataFrame:
    return entries_of(read_lines(spark, roots, layouts, pattern))


def unreadable_files(entries: DataFrame) -> DataFrame:
    """Files that hold values but none that can be read, mostly because the layout is wrong."""
    counted = entries.groupBy("file_path").agg(
        F.count_if("unreadable").alias("unreadable"), F.count("*").alias("entries")
    )
    return counted.filter("unreadable = entries").select("file_path", "unreadable")


def raw_records(entries: DataFrame) -> DataFrame:
    """Flatten payloads to records, all fields as text."""
    return entries.select(
        "file_path",
        LINEAGE,
        F.col("metadata.status").alias("status"),
        F.posexplode("records").alias("record", "_r"),
    ).select("file_path", LINEAGE, "record", "status", "_r.*")
