"""Record rules and the batch gate. Everything works inside a payload row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import finite
from ledgerline.functions.times import utc_naive
from ledgerline.schemas import PRICE_COLUMNS, RECORD_COLUMNS
from ledgerline.sources.raw import LINEAGE

# What the provider calls its columns, and their canonical names.
SOURCE_COLUMNS = ["time", "open", "high", "low", "close", "volume"]
SOURCE_NAMES = {
    "time": "trading_date",
    "open": "open_price",
    "high": "high_price",
    "low": "low_price",
    "close": "close_price",
}


def normalize_columns(frame: DataFrame, ticker: str | Column) -> DataFrame:
    """Provider columns to canonical ones, with the upper-cased ticker in front."""
    absent = set(SOURCE_COLUMNS).difference(frame.columns)
    if absent:
        raise ValueError(f"BAD_DATA: the provider frame has no {', '.join(sorted(absent))}")
    symbol = F.lit(ticker) if isinstance(ticker, str) else ticker
    return frame.select(
        F.upper(symbol).alias("ticker"),
        *[F.col(name).alias(SOURCE_NAMES.get(name, name)) for name in SOURCE_COLUMNS],
    )


def _number(text: Column) -> Column:
    return finite(F.trim(text).try_cast("double"))


def typed_fields(record: Column) -> dict[str, Column]:
    """Text fields to their declared types; what does not fit becomes null."""
    volume = _number(record["volume"])
    whole = F.when(volume == F.floor(volume), volume.try_cast("bigint"))
    return {
        "ticker": record["ticker"],
        "trading_date": utc_naive(record["trading_date"]),
        **{name: _number(record[name]) for name in PRICE_COLUMNS},
        "volume": whole,
    }


def _rules(raw: Column, typed: Column) -> Column:
    checks: list[Column] = []
    for name in RECORD_COLUMNS:
        absent = raw[name].isNull()
        checks.append(F.when(absent, F.lit(f"missing:{name}")))
        checks.append(F.when(~absent & typed[name].isNull(), F.lit(f"malformed:{name}")))
    length = F.length(typed["ticker"])
    checks.append(F.when((length < 1) | (length > 20), F.lit("length:ticker")))
    checks += [F.when(typed[n] <= 0, F.lit(f"not_positive:{n}")) for n in PRICE_COLUMNS]
    checks.append(F.when(typed["volume"] < 0, F.lit("negative:volume")))
    checks.append(F.when(typed["high_price"] < typed["low_price"], F.lit("high_below_low")))
    return F.array_compact(F.array(*checks))


def check_records(records: str | Column) -> Column:
    """Array of raw records to an array of ``{typed, violations}``.

    Two passes over the array, so every field is parsed once and then judged.
    """
    parsed = F.transform(
        records,
        lambda r: F.struct(
            r.alias("raw"),
            F.struct(*[e.alias(n) for n, e in typed_fields(r).items()]).alias("typed"),
        ),
    )
    return F.transform(
        parsed,
        lambda p: F.struct(
            p["typed"].alias("typed"), _rules(p["raw"], p["typed"]).alias("violations")
        ),
    )


def violations(record: str) -> Column:
    """Names of the rules a raw record breaks, in a fixed order."""
    return F.element_at(check_records(F.array(F.col(record))), 1)["violations"]


def status_filter(entries: DataFrame) -> DataFrame:
    """Payloads that passed at the source; a missing status counts as passed."""
    return entries.filter(F.coalesce(F.col("metadata.status"), F.lit("PASS")) == "PASS")


def gate_batches(entries: DataFrame) -> DataFrame:
    """Judge each payload as a whole: one bad record fails all of its records."""
    checked = entries.withColumn("checked", check_records("records"))
    bad = F.size(F.filter("checked", lambda r: F.size(r["violations"]) > 0))
    given = F.col("metadata.status")
    code = (
        F.when(F.col("unreadable"), F.lit("BAD_DATA"))
        .when(given == "FAIL", F.coalesce(F.col("metadata.error_code"), F.lit("SOURCE_ERROR")))
        .when(F.size("records") == 0, F.lit("NO_DATA"))
        .when(bad > 0, F.lit("BAD_DATA"))
        .otherwise(F.lit("OK"))
    )
    return checked.withColumns({"bad_records": bad, "gate_code": code}).withColumn(
        "gate_status", F.when(F.col("gate_code") == "OK", "PASS").otherwise("FAIL")
    )


def accepted_records(entries: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Typed records of the payloads that pass; ``lineage`` orders them.

    With ``fail_fast`` a bad record aborts the job; otherwise its batch is left out and
    shows up in ``rejected_batches``.
    """
    gated = gate_batches(status_filter(entries))
    if fail_fast:
        message = F.concat(F.lit("invalid record in "), F.col("file_path"))
        broken = F.col("unreadable") | (F.col("bad_records") > 0)
        gated = gated.withColumn(
            "gate_status", F.when(broken, F.raise_error(message)).otherwise(F.col("gate_status"))
        )
    # The gate empties the array instead of filtering rows: a filter would move below
    # the parsing and evaluate it a second time.
    kept = F.when(F.col("gate_status") == "PASS", F.col("checked"))
    return gated.select(LINEAGE, F.posexplode(kept).alias("record", "_r")).select(
        *[F.col(f"_r.typed.{name}").alias(name) for name in RECORD_COLUMNS],
        F.struct(f"{LINEAGE}.*", "record").alias(LINEAGE),
    )


def _broken_rules() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform("checked", lambda r: r["violations"]))))


def failure_message(gated: DataFrame) -> Column:
    """Why a gated payload failed: the rules its records break, else the class of its failure."""
    rules = F.when(F.col("bad_records") > 0, F.concat(F.lit("invalid record: "), F.array_join(_broken_rules(), ", ")))
    return F.when(F.col("gate_status") == "FAIL", F.coalesce(rules, F.concat(F.lit("failed: "), "gate_code")))


def rejected_batches(entries: DataFrame) -> DataFrame:
    """Payloads that did not pass, with the rules their records break."""
    gated = gate_batches(entries).filter(F.col("gate_status") == "FAIL")
    broken = _broken_rules()
    return gated.select(
        "file_path",
        LINEAGE,
        F.col("metadata.ticker").alias("ticker"),
        "gate_code",
        "bad_records",
        broken.alias("violations"),
    )


def batch_messages(entries: DataFrame) -> DataFrame:
    """Per payload the messages ``row=i: rules`` of its bad records, joined by a pipe."""
    checked = entries.withColumn("_checked", check_records("records"))
    numbered = F.transform(
        "_checked",
        lambda r, i: F.when(
            F.size(r["violations"]) > 0,
            F.concat(F.lit("row="), (i + 1).cast("string"), F.lit(": "), F.array_join(r["violations"], ",")),
        ),
    )
    joined = F.array_join(F.array_compact(numbered), " | ")
    return checked.withColumn("messages", joined).drop("_checked")
