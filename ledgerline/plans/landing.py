"""Raw layer to curated layer, on batches that Spark lands from the daily bars.

Faults are part of the landed data: one ticker's batches failed at the source, one is
landed again with corrected closes, one has a record that breaks a rule, one carries
+07:00 timestamps, one has no metadata.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.text import (
    ERROR_CLASSES,
    LEGACY_ERROR_CLASSES,
    error_class,
    safe_ticker,
    ticker_list,
)
from ledgerline.functions.times import utc_naive
from ledgerline.operators import curate, ledger, quality
from ledgerline.operators.ingest import ingest as ingest_payloads
from ledgerline.plans.inputs import BARS_SQL, layer, stored_bars, table
from ledgerline.plans.market import CURATED_SQL, NUMBERED_SQL
from ledgerline.plans.registry import Catalog, with_parts
from ledgerline.schemas import PRICE_COLUMNS
from ledgerline.session import configure, source_version, work_dir
from ledgerline.sinks.curated import write_curated
from ledgerline.sinks.raw import write_payloads
from ledgerline.sources import curated as curated_source
from ledgerline.sources.raw import LINEAGE, raw_records, read_entries
from ledgerline.streaming.jobs import curated_stream_job, ledger_stream_job, read_curated_stream

landing = Catalog()

FAILED, CORRECTED, BROKEN, ZONED, BARE = (
    "BRAND.1",
    "BRAND.10",
    "BRAND.11",
    "BRAND.12",
    "BRAND.13",
)


# Files a micro-batch of the streaming query takes.
STREAM_FILES = 24


def payloads(bars):
    """One payload per ticker and quarter: a payload never outgrows its quarter."""
    iso = F.date_format("trading_date", "yyyy-MM-dd'T'HH:mm:ss")
    broken = (F.col("ticker") == BROKEN) & (F.month("trading_date") == 2) & (F.dayofmonth("trading_date") == 14)
    text = {name: F.col(name).cast("string") for name in PRICE_COLUMNS}
    text["high_price"] = F.when(broken, F.col("low_price") * 0.5).otherwise(F.col("high_price")).cast("string")
    record = F.struct(
        "ticker",
        F.when(F.col("ticker") == ZONED, F.concat(iso, F.lit("+07:00"))).otherwise(iso).alias("trading_date"),
        *[text[name].alias(name) for name in PRICE_COLUMNS],
        F.col("volume").cast("string").alias("volume"),
    )
    quarter = F.trunc(F.to_date("trading_date"), "quarter")
    failed = F.col("ticker") == FAILED
    grouped = bars.groupBy("ticker", quarter.alias("batch_date")).agg(
        F.array_sort(F.collect_list(F.when(~failed, record))).alias("records"),
        F.count(F.when(~failed, 1)).alias("_n"),
    )
    stamp = F.date_format("batch_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    metadata = F.struct(
        F.lit("1.0").alias("schema_version"),
        F.lit("files").alias("access_library"),
        F.lit("FEED").alias("provider"),
        "ticker",
        F.when(failed, "FAIL").otherwise("PASS").alias("status"),
        F.when(failed, "RATE_LIMIT").otherwise("OK").alias("error_code"),
        F.col("_n").alias("rows"),
        F.when(failed, 3).otherwise(1).alias("attempts"),
        stamp.alias("requested_at"),
        stamp.alias("completed_at"),
    )
    return grouped.select(
        "batch_date", F.when(F.col("ticker") != BARE, metadata).alias("metadata"), "records"
    )


def corrections(bars):
    """A later delivery of one ticker: even days again, close one percent higher."""
    even = (F.col("ticker") == CORRECTED) & (F.dayofmonth("trading_date") % 2 == 0)
    return bars.filter(even).withColumn("close_price", F.col("close_price") * 1.01)


def _land(spark, sf_dir):
    root = work_dir(spark, "raw")
    day_bars = stored_bars(spark, sf_dir)
    write_payloads(payloads(day_bars), f"{root}/first")
    write_payloads(payloads(corrections(day_bars)), f"{root}/second")
    return root


_ROOTS: dict = {}


def landed_root(spark, sf_dir) -> str:
    """Folder with the landed batches, written once per application and input folder."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir, source_version(spark, sf_dir))
    if key not in _ROOTS:
        _ROOTS[key] = _land(spark, sf_dir)
    return _ROOTS[key]


def landed(spark, sf_dir):
    """Payloads of both deliveries in reading order."""
    root = landed_root(spark, sf_dir)
    return read_entries(spark, [f"{root}/first", f"{root}/second"])


# What lands: every bar with its delivery and the faults above.
LANDED_SQL = f"""
landed AS (
  SELECT 0 AS root, ticker, trading_date, open_price,
         CASE WHEN ticker = '{BROKEN}' AND month(trading_date) = 2 AND day(trading_date) = 14
              THEN low_price * 0.5 ELSE high_price END AS high_price,
         low_price, close_price, volume, date_trunc('quarter', trading_date) AS batch
  FROM bars WHERE ticker <> '{FAILED}'
  UNION ALL
  SELECT 1, ticker, trading_date, open_price, high_price, low_price, close_price * 1.01, volume,
         date_trunc('quarter', trading_date)
  FROM bars WHERE ticker = '{CORRECTED}' AND day(trading_date) % 2 = 0)
"""

# Valid records, UTC, last delivery wins.
CLEAN_SQL = f"""
gate AS (SELECT ticker, batch FROM landed GROUP BY ticker, batch, root HAVING bool_or(high_price < low_price)),
clean AS (
  SELECT ticker, CASE WHEN ticker = '{ZONED}' THEN trading_date - INTERVAL 7 HOUR ELSE trading_date END AS trading_date,
         max_by(open_price, root) AS open_price, max_by(high_price, root) AS high_price,
         max_by(low_price, root) AS low_price, max_by(close_price, root) AS close_price, max_by(volume, root) AS volume
  FROM landed l
  WHERE NOT EXISTS (SELECT 1 FROM gate g WHERE g.ticker = l.ticker AND g.batch = l.batch)
  GROUP BY 1, 2)
"""


def landed_oracle(body: str, *more: str) -> str:
    return with_parts(BARS_SQL, LANDED_SQL, *more, body=body)


def curated_from_clean(body: str) -> str:
    numbered = NUMBERED_SQL.replace("FROM bars", "FROM clean")
    return with_parts(
        BARS_SQL, LANDED_SQL, CLEAN_SQL, numbered, CURATED_SQL, body=body, recursive=True
    )


_ZONED_TEXT = f"""strftime(trading_date, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN ticker = '{ZONED}' THEN '+07:00' ELSE '' END AS trading_date"""


def _landed_arrays(spark, sf_dir) -> str:
    """The second delivery as one JSON value a file: an indented array per year, in even years
    behind a byte order mark, and a single object for the first quarters."""
    root = work_dir(configure(spark), "arrays")
    pretty = {"pretty": "true"}
    quarters = payloads(corrections(stored_bars(spark, sf_dir))).withColumn("year", F.year("batch_date"))
    single = F.month("batch_date") == 1
    payload = F.struct("metadata", "records")
    objects = quarters.filter(single).select(
        F.date_format("batch_date", "yyyyMMdd").alias("part"), F.to_json(payload, pretty).alias("value")
    )
    mark = F.when(F.col("year") % 2 == 0, "\ufeff").otherwise("")
    # An array is a year of one ticker here: four payloads.
    arrays = quarters.filter(~single).groupBy("year").agg(F.array_sort(F.collect_list(payload)).alias("all"))
    arrays = arrays.select(
        F.col("year").cast("string").alias("part"), F.concat(mark, F.to_json("all", pretty)).alias("value")
    )
    objects.unionByName(arrays).write.partitionBy("part").text(root)
    return root


def _raw_out(records):
    return records.select(
        "ticker",
        "trading_date",
        *[F.col(n).cast("double").alias(n) for n in PRICE_COLUMNS],
        F.col("volume").cast("bigint").alias("volume"),
    )


@landing.query(
    "raw_scan",
    landed_oracle(
        f"""SELECT ticker, {_ZONED_TEXT}, open_price, high_price, low_price, close_price, volume
            FROM landed"""
    ),
)
def raw_scan(spark, sf_dir):
    """Both deliveries: the first by line, the second as indented arrays and single objects."""
    root = landed_root(spark, sf_dir)
    arrays = _landed_arrays(spark, sf_dir)
    lines = read_entries(spark, [f"{root}/first"])
    values = read_entries(spark, [arrays], "array", pattern="*.txt")
    return _raw_out(raw_records(lines.unionByName(values)))


@landing.query(
    "raw_multi_root",
    landed_oracle(
        f"""SELECT CAST(root AS INT) AS root, ticker, {_ZONED_TEXT}, close_price FROM landed"""
    ),
)
def raw_multi_root(spark, sf_dir):
    root = landed_root(spark, sf_dir)
    # The third root covers the first two again, the second one does not exist.
    roots = [f"{root}/first", f"{root}/absent", f"{root}/second", root]
    records = raw_records(read_entries(spark, roots))
    return records.select(
        (F.col(f"{LINEAGE}.root") / 2).cast("int").alias("root"),
        "ticker",
        "trading_date",
        F.col("close_price").cast("double").alias("close_price"),
    )


@landing.query(
    "raw_sink",
    with_parts(
        BARS_SQL,
        body=f"""
        SELECT strftime(batch, '%Y') AS year, strftime(batch, '%m') AS month, strftime(batch, '%d') AS day,
               count(*) AS payloads, CAST(sum(n) AS BIGINT) AS records
        FROM (SELECT ticker, date_trunc('quarter', trading_date) AS batch,
                     count(*) FILTER (WHERE ticker <> '{FAILED}') AS n
              FROM bars GROUP BY 1, 2) b
        GROUP BY 1, 2, 3""",
    ),
)
def raw_sink(spark, sf_dir):
    root = work_dir(configure(spark), "raw-sink")
    write_payloads(payloads(stored_bars(spark, sf_dir)), root)
    entries = read_entries(spark, [root])
    part = [F.regexp_extract("file_path", f"{n}=([0-9]+)", 1).alias(n) for n in ["year", "month", "day"]]
    return entries.groupBy(*part).agg(
        F.count("*").alias("payloads"), F.sum(F.size("records")).cast("bigint").alias("records")
    )


def _provider_rows(spark, sf_dir):
    """Bars under the provider's column names; one ticker has a broken day a year."""
    broken = (F.col("ticker") == BROKEN) & (F.month("trading_date") == 2) & (F.dayofmonth("trading_date") == 14)
    return stored_bars(spark, sf_dir).select(
        "ticker",
        F.col("trading_date").alias("time"),
        F.col("open_price").alias("open"),
        F.when(broken, F.col("low_price") * 0.5).otherwise(F.col("high_price")).alias("high"),
        F.col("low_price").alias("low"),
        F.col("close_price").alias("close"),
        "volume",
    )


def _requests(spark, sf_dir):
    """Every brand and every supplier is asked for, some twice; suppliers have no bars."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    brands = part.select(
        F.concat(F.lit(" "), F.lower(F.replace("p_brand", F.lit("#"), F.lit(".")))).alias("ticker"),
        F.col("p_partkey").alias("position"),
    )
    others = supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("ticker"), (-F.col("s_suppkey")).alias("position")
    )
    failed = F.upper(F.trim("ticker")) == FAILED
    return brands.unionByName(others).select(
        "ticker",
        "position",
        F.when(failed, 3).otherwise(1).alias("attempts"),
        F.when(failed, "Rate limit exceeded").alias("message"),
        F.lit("2025-01-01T00:00:00Z").alias("requested_at"),
        F.lit("2025-01-01T00:00:05Z").alias("completed_at"),
    )


@landing.query(
    "ingest",
    with_parts(
        BARS_SQL,
        LANDED_SQL,
        body=f"""
        SELECT ticker, CAST(batch AS DATE) AS batch_date, CASE WHEN bool_or(high_price < low_price) THEN 'FAIL' ELSE 'PASS' END AS status,
               CASE WHEN bool_or(high_price < low_price) THEN 'BAD_DATA' ELSE 'OK' END AS error_code,
               CAST(CASE WHEN bool_or(high_price < low_price) THEN 0 ELSE count(*) END AS INT) AS rows, 1 AS attempts
        FROM landed WHERE root = 0 GROUP BY ticker, batch
        UNION ALL SELECT '{FAILED}', NULL, 'FAIL', 'RATE_LIMIT', 0, 3 FROM part
        WHERE upper(replace(p_brand, '#', '.')) = '{FAILED}' GROUP BY p_brand
        UNION ALL SELECT 'S' || s_suppkey, NULL, 'FAIL', 'NO_DATA', 0, 1 FROM supplier""",
    ),
)
def ingest(spark, sf_dir):
    landed_payloads = ingest_payloads(_requests(spark, sf_dir), _provider_rows(spark, sf_dir), "FEED")
    meta = ["ticker", "status", "error_code", "rows", "attempts"]
    return landed_payloads.select("batch_date", *[F.col(f"metadata.{m}").alias(m) for m in meta])


@landing.query(
    "normalize_columns",
    with_parts(BARS_SQL, body="SELECT * FROM bars"),
)
def normalize_columns(spark, sf_dir):
    provider = stored_bars(spark, sf_dir).select(
        F.lower("ticker").alias("symbol"),
        F.col("trading_date").alias("time"),
        F.col("open_price").alias("open"),
        F.col("high_price").alias("high"),
        F.col("low_price").alias("low"),
        F.col("close_price").alias("close"),
        "volume",
    )
    return quality.normalize_columns(provider, F.col("symbol"))


@landing.query(
    "safe_ticker",
    r"""
    SELECT p_partkey, raw, CASE WHEN regexp_full_match(upper(trim(raw)), '[A-Z0-9._-]{1,20}')
                           THEN upper(trim(raw)) END AS ticker
    FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '  ' || lower(replace(p_brand, '#', '.')) || ' '
                                   WHEN 1 THEN p_brand WHEN 2 THEN p_name ELSE p_type END AS raw FROM part) t""",
)
def safe_tickers(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    dotted = F.lower(F.replace("p_brand", F.lit("#"), F.lit(".")))
    raw = (
        F.when(kind == 0, F.concat(F.lit("  "), dotted, F.lit(" ")))
        .when(kind == 1, F.col("p_brand"))
        .when(kind == 2, F.col("p_name"))
        .otherwise(F.col("p_type"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return part.select("p_partkey", "raw", safe_ticker(F.col("raw")).alias("ticker"))


# Records with rule-breaking values spread over the bars by their volume.
FAULTY_SQL = """
faulty AS (
  SELECT CASE WHEN volume % 31 = 7 THEN '' WHEN volume % 31 = 8 THEN NULL ELSE ticker END AS ticker,
         trading_date AS bar_date, ticker AS series,
         CASE WHEN volume % 29 = 3 THEN 'not a date' ELSE strftime(trading_date, '%Y-%m-%d') END AS trading_date,
         CASE WHEN volume % 23 = 5 THEN 0e0 ELSE open_price END AS open_price,
         CASE WHEN volume % 19 = 2 THEN low_price * 0.5 ELSE high_price END AS high_price,
         low_price,
         CASE WHEN volume % 17 = 4 THEN NULL ELSE close_price END AS close_price,
         CASE WHEN volume % 13 = 6 THEN CAST(-volume AS VARCHAR) WHEN volume % 13 = 7 THEN volume || '.5' ELSE CAST(volume AS VARCHAR) END AS volume_text
  FROM bars)
"""


def faulty_records(spark, sf_dir):
    volume = F.col("volume")
    return stored_bars(spark, sf_dir).select(
        F.col("ticker").alias("series"),
        F.col("trading_date").alias("bar_date"),
        F.struct(
            F.when(volume % 31 == 7, "").when(volume % 31 == 8, None).otherwise(F.col("ticker")).alias("ticker"),
            F.when(volume % 29 == 3, "not a date").otherwise(F.date_format("trading_date", "yyyy-MM-dd")).alias("trading_date"),
            F.when(volume % 23 == 5, 0.0).otherwise(F.col("open_price")).cast("string").alias("open_price"),
            F.when(volume % 19 == 2, F.col("low_price") * 0.5).otherwise(F.col("high_price")).cast("string").alias("high_price"),
            F.col("low_price").cast("string").alias("low_price"),
            F.when(volume % 17 == 4, None).otherwise(F.col("close_price")).cast("string").alias("close_price"),
            F.when(volume % 13 == 6, (-volume).cast("string"))
            .when(volume % 13 == 7, F.concat(volume.cast("string"), F.lit(".5")))
            .otherwise(volume.cast("string"))
            .alias("volume"),
        ).alias("raw"),
    )


_VIOLATIONS_SQL = """
  concat_ws(',',
    CASE WHEN ticker IS NULL THEN 'missing:ticker' END,
    CASE WHEN trading_date = 'not a date' THEN 'malformed:trading_date' END,
    CASE WHEN close_price IS NULL THEN 'missing:close_price' END,
    CASE WHEN volume_text LIKE '%.5' THEN 'malformed:volume' END,
    CASE WHEN length(ticker) = 0 THEN 'length:ticker' END,
    CASE WHEN open_price <= 0 THEN 'not_positive:open_price' END,
    CASE WHEN volume_text LIKE '-%' THEN 'negative:volume' END,
    CASE WHEN high_price < low_price THEN 'high_below_low' END)
"""


@landing.query(
    "dq_rules",
    with_parts(
        BARS_SQL,
        FAULTY_SQL,
        body=f"SELECT series, bar_date, {_VIOLATIONS_SQL} AS violations FROM faulty",
    ),
)
def dq_rules(spark, sf_dir):
    broken = quality.violations("raw")
    return faulty_records(spark, sf_dir).select(
        "series", "bar_date", F.array_join(broken, ",").alias("violations")
    )


@landing.query(
    "coerce_types",
    with_parts(
        BARS_SQL,
        FAULTY_SQL,
        body=f"""
        SELECT series, batch, coalesce(string_agg('row=' || r || ': ' || v, ' | ' ORDER BY r) FILTER (WHERE v <> ''), '') AS messages,
               count(*) AS records, count(*) FILTER (WHERE v <> '') AS bad_records
        FROM (SELECT series, date_trunc('quarter', bar_date) AS batch, {_VIOLATIONS_SQL} AS v,
                     row_number() OVER (PARTITION BY series, date_trunc('quarter', bar_date) ORDER BY bar_date) AS r
              FROM faulty) x
        GROUP BY series, batch""",
    ),
)
def coerce_types(spark, sf_dir):
    quarter = F.date_trunc("quarter", "bar_date").cast("timestamp_ntz")
    ordered = F.array_sort(F.collect_list(F.struct("bar_date", "raw")))
    batches = (
        faulty_records(spark, sf_dir)
        .groupBy("series", quarter.alias("batch"))
        .agg(ordered.alias("_pairs"))
        .withColumn("records", F.col("_pairs.raw"))
    )
    told = quality.batch_messages(batches)
    bad = F.when(F.col("messages") == "", 0).otherwise(F.size(F.split("messages", r" \| ")))
    return told.select(
        "series",
        "batch",
        "messages",
        F.size("records").cast("bigint").alias("records"),
        bad.cast("bigint").alias("bad_records"),
    )


@landing.query(
    "batch_gate",
    with_parts(
        BARS_SQL,
        LANDED_SQL,
        body=f"""
        SELECT CASE WHEN ticker = '{BARE}' THEN NULL ELSE ticker END AS ticker,
               CASE WHEN bool_or(high_price < low_price) THEN 'FAIL' ELSE 'PASS' END AS gate_status,
               CASE WHEN bool_or(high_price < low_price) THEN 'BAD_DATA' ELSE 'OK' END AS gate_code,
               count(*) AS records, count(*) FILTER (WHERE high_price < low_price) AS bad_records
        FROM landed GROUP BY ticker, batch, root
        UNION ALL
        SELECT '{FAILED}', 'FAIL', 'RATE_LIMIT', 0, 0 FROM bars WHERE ticker = '{FAILED}'
        GROUP BY date_trunc('quarter', trading_date)""",
    ),
)
def batch_gate(spark, sf_dir):
    return quality.gate_batches(landed(spark, sf_dir)).select(
        F.col("metadata.ticker").alias("ticker"),
        "gate_status",
        "gate_code",
        F.size("records").cast("bigint").alias("records"),
        F.col("bad_records").cast("bigint").alias("bad_records"),
    )


@landing.query(
    "rejected_batches",
    with_parts(
        BARS_SQL,
        LANDED_SQL,
        body=f"""
        SELECT ticker, 'BAD_DATA' AS gate_code, 'high_below_low' AS violations, count(*) AS batches
        FROM (SELECT ticker, batch FROM landed GROUP BY ticker, batch, root HAVING bool_or(high_price < low_price)) b
        GROUP BY ticker
        UNION ALL
        SELECT '{FAILED}', 'RATE_LIMIT', '', count(DISTINCT date_trunc('quarter', trading_date)) FROM bars
        WHERE ticker = '{FAILED}' HAVING count(*) > 0""",
    ),
)
def rejected_batches(spark, sf_dir):
    rejected = quality.rejected_batches(landed(spark, sf_dir))
    return rejected.groupBy(
        "ticker", "gate_code", F.array_join("violations", ",").alias("violations")
    ).agg(F.count("*").alias("batches"))


@landing.query(
    "status_filter",
    landed_oracle(
        """SELECT count(*) AS payloads, CAST(sum(n) AS BIGINT) AS records
           FROM (SELECT count(*) AS n FROM landed GROUP BY ticker, batch, root) p"""
    ),
)
def status_filter(spark, sf_dir):
    return quality.status_filter(landed(spark, sf_dir)).agg(
        F.count("*").alias("payloads"), F.sum(F.size("records")).cast("bigint").alias("records")
    )


@landing.query(
    "utc_normalize",
    """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN o_orderdate - INTERVAL 7 HOUR ELSE o_orderdate END AS trading_date
    FROM orders""",
)
def utc_normalize(spark, sf_dir):
    kind = F.col("o_orderkey") % 3
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    suffix = F.when(kind == 0, "Z").when(kind == 1, "+07:00").otherwise("")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", utc_naive(F.concat(iso, suffix)).alias("trading_date")
    )


@landing.query(
    "legacy_cast",
    with_parts(
        BARS_SQL,
        body="""SELECT ticker, trading_date, CAST(open_price AS FLOAT) AS open_price, CAST(high_price AS FLOAT) AS high_price,
                CAST(low_price AS FLOAT) AS low_price, CAST(close_price AS FLOAT) AS close_price, volume FROM bars""",
    ),
)
def legacy_cast(spark, sf_dir):
    return stored_bars(spark, sf_dir).select(
        "ticker",
        "trading_date",
        *[F.col(n).cast("float").alias(n) for n in PRICE_COLUMNS],
        F.col("volume").cast("bigint").alias("volume"),
    )


# One message per order; the order key picks the wording.
_MESSAGES = [
    "HTTP 429: Rate limit reached",
    "Giới hạn API: thử lại sau",
    "EmptyData for this range",
    "Symbol not found",
    "Invalid ticker: no rows",
    "BAD_DATA: missing source columns",
    "high_price must be greater than or equal to low_price",
    "mã không hợp lệ",
    "connection reset by peer",
]


def _class_sql(column: str, classes: list) -> str:
    branches = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + f" THEN '{name}'"
        for name, words in classes
    )
    return f"CASE {branches} ELSE 'SOURCE_ERROR' END"


_MESSAGE_SQL = (
    "list_extract(["
    + ", ".join(f"'{m}'" for m in _MESSAGES)
    + f"], CAST(o_orderkey % {len(_MESSAGES)} + 1 AS INT)) || ' #' || o_custkey"
)


def _messages(spark, sf_dir):
    words = F.array(*[F.lit(m) for m in _MESSAGES])
    index = (F.col("o_orderkey") % len(_MESSAGES) + 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.element_at(words, index), F.lit(" #"), F.col("o_custkey").cast("string")).alias("message"),
    )


@landing.query(
    "error_class",
    f"""SELECT o_orderkey, message, {_class_sql('message', ERROR_CLASSES)} AS error_code,
               {_class_sql('message', LEGACY_ERROR_CLASSES)} AS legacy_code
        FROM (SELECT o_orderkey, {_MESSAGE_SQL} AS message FROM orders) m""",
)
def error_classes(spark, sf_dir):
    message = F.col("message")
    return _messages(spark, sf_dir).select(
        "o_orderkey",
        "message",
        error_class(message).alias("error_code"),
        error_class(message, LEGACY_ERROR_CLASSES).alias("legacy_code"),
    )


@landing.query(
    "dedup_last",
    with_parts(BARS_SQL, LANDED_SQL, CLEAN_SQL, body="SELECT * FROM clean"),
)
def dedup_last(spark, sf_dir):
    return curate.unique_bars(landed(spark, sf_dir))


@landing.query(
    "dedup_list",
    """
    SELECT o_custkey, array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ',') AS tickers
    FROM (SELECT o_custkey, list_transform(string_split(txt, ','), lambda x: upper(trim(x))) AS parts
          FROM (SELECT o_custkey, o_orderstatus || ',' || o_orderpriority || ', ' || lower(o_orderpriority) || ', A,' || o_orderstatus AS txt
                FROM (SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders) d) t) p""",
)
def dedup_list(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus").distinct()
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    text = F.concat(status, F.lit(","), priority, F.lit(", "), F.lower(priority), F.lit(", A,"), status)
    return asked.select("o_custkey", F.array_join(ticker_list(text), ",").alias("tickers"))


@landing.query("curated_sink", curated_from_clean("SELECT * FROM curated"))
def curated_sink(spark, sf_dir):
    root = work_dir(configure(spark), "curated")
    curate.transform(spark, landed(spark, sf_dir), root)
    return curated_source.read_curated(spark, root)


@landing.query(
    "curated_replace",
    with_parts(
        BARS_SQL,
        body=f"""
        SELECT ticker, trading_date, CASE WHEN ticker = '{CORRECTED}' THEN close_price * 1.01 ELSE close_price END AS close_price
        FROM bars WHERE ticker <> '{CORRECTED}' OR day(trading_date) % 2 = 0""",
    ),
)
def curated_replace(spark, sf_dir):
    """A second write replaces its own ticker only, even where that makes it shorter."""
    root = work_dir(configure(spark), "curated")
    bars = stored_bars(spark, sf_dir)
    blank = [F.lit(None).cast("double").alias(n) for n in ["return_pct", "ma20", "rsi_14"]]
    write_curated(bars.select("*", *blank), root)
    write_curated(corrections(bars).select("*", *blank), root)
    return curated_source.read_curated(spark, root).select("ticker", "trading_date", "close_price")


@landing.query(
    "transform_summary",
    with_parts(
        BARS_SQL,
        LANDED_SQL,
        CLEAN_SQL,
        body=f"""
        SELECT (SELECT count(DISTINCT date_trunc('quarter', trading_date)) FROM bars) +
               (SELECT count(DISTINCT batch) FROM landed WHERE root = 1) AS input_files,
               count(DISTINCT ticker) AS output_files, count(*) AS rows, count(DISTINCT ticker) AS tickers FROM clean""",
    ),
)
def transform_summary(spark, sf_dir):
    """Of batches landed as one file a quarter; a ticker's curated rows fill one file."""
    raw, root = work_dir(configure(spark), "raw"), work_dir(spark, "curated")
    day_bars = stored_bars(spark, sf_dir)
    for part, bars in (("first", day_bars), ("second", corrections(day_bars))):
        # One task a quarter is enough: what it holds is one payload per ticker.
        write_payloads(payloads(bars).repartition("batch_date").coalesce(1), f"{raw}/{part}")
    return curate.transform(spark, read_entries(spark, [f"{raw}/first", f"{raw}/second"]), root)


def _gate_results(spark, sf_dir):
    gated = quality.gate_batches(landed(spark, sf_dir))
    return gated.select(
        F.coalesce("metadata.ticker", F.lit(BARE)).alias("ticker"),
        F.col("gate_status").alias("status"),
        F.col("gate_code").alias("error_code"),
        F.when(F.col("gate_status") == "PASS", F.size("records")).otherwise(0).cast("bigint").alias("rows"),
        quality.failure_message(gated).alias("message"),
        F.coalesce("metadata.completed_at", F.lit("")).alias("finished_at"),
        F.struct(f"{LINEAGE}.*").alias("at"),
    )


# One row per attempt: gate outcome of every payload.
ATTEMPTS_SQL = f"""
attempts AS (
  SELECT ticker, batch, root, CASE WHEN bool_or(high_price < low_price) THEN 'FAIL' ELSE 'PASS' END AS status,
         CASE WHEN bool_or(high_price < low_price) THEN 'BAD_DATA' ELSE 'OK' END AS error_code,
         CASE WHEN bool_or(high_price < low_price) THEN 0 ELSE count(*) END AS rows
  FROM landed GROUP BY ticker, batch, root
  UNION ALL
  SELECT ticker, date_trunc('quarter', trading_date), 0, 'FAIL', 'RATE_LIMIT', 0
  FROM bars WHERE ticker = '{FAILED}' GROUP BY ALL)
"""


@landing.query(
    "ingestion_summary",
    landed_oracle(
        """SELECT count(*) AS requested, count(*) FILTER (WHERE status = 'PASS') AS passed,
                  count(*) FILTER (WHERE status = 'FAIL') AS failed FROM attempts""",
        ATTEMPTS_SQL,
    ),
)
def ingestion_summary(spark, sf_dir):
    return ledger.ingestion_summary(_gate_results(spark, sf_dir))


@landing.query(
    "batch_attempts",
    landed_oracle(
        f"""SELECT ticker, status, error_code, CAST(rows AS BIGINT) AS rows,
                  CASE error_code WHEN 'BAD_DATA' THEN 'invalid record: high_below_low' WHEN 'RATE_LIMIT' THEN 'failed: RATE_LIMIT' END AS message,
                  CASE WHEN ticker = '{BARE}' THEN '' ELSE strftime(batch, '%Y-%m-%dT%H:%M:%SZ') END AS finished_at
           FROM attempts""",
        ATTEMPTS_SQL,
    ),
)
def batch_attempts(spark, sf_dir):
    """Every attempt with its outcome, why it failed and when it ended."""
    return _gate_results(spark, sf_dir).select("ticker", "status", "error_code", "rows", "message", "finished_at")


@landing.query(
    "batch_totals",
    landed_oracle(
        """SELECT count(*) AS attempts, count(*) FILTER (WHERE status = 'PASS') AS passed,
                  count(*) FILTER (WHERE status = 'FAIL') AS failed, CAST(sum(rows) AS BIGINT) AS rows,
                  array_to_string(list_sort(list_distinct(list(ticker) FILTER (WHERE status = 'FAIL'))), ',') AS failed_tickers
           FROM attempts""",
        ATTEMPTS_SQL,
    ),
)
def batch_totals(spark, sf_dir):
    return ledger.batch_totals(_gate_results(spark, sf_dir))


@landing.query(
    "batch_report",
    landed_oracle(
        """SELECT ticker, count(*) AS attempts, count(*) FILTER (WHERE status = 'PASS') AS passed,
                  count(*) FILTER (WHERE status = 'FAIL') AS failed, CAST(sum(rows) AS BIGINT) AS rows
           FROM attempts GROUP BY ticker""",
        ATTEMPTS_SQL,
    ),
)
def batch_report(spark, sf_dir):
    return ledger.batch_report(_gate_results(spark, sf_dir))


@landing.query(
    "curated_stream",
    curated_from_clean("SELECT * FROM curated"),
)
def curated_stream(spark, sf_dir):
    """All landed files in several micro-batches: whole quarters come late, and corrections last."""
    root = landed_root(spark, sf_dir)
    out = work_dir(spark, "stream")
    curated_stream_job(spark, root, out, files_per_batch=STREAM_FILES)
    return read_curated_stream(spark, out)


@landing.query(
    "ledger_stream",
    landed_oracle(
        """SELECT ticker, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed,
                  coalesce(max(error_code) FILTER (WHERE status = 'FAIL'), 'OK') AS last_error
           FROM attempts GROUP BY ticker""",
        ATTEMPTS_SQL,
    ),
)
def ledger_stream(spark, sf_dir):
    root = landed_root(spark, sf_dir)
    return ledger_stream_job(spark, root, work_dir(spark, "ledger"))
