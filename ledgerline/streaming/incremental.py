"""Online indicators: each micro-batch continues the series where it still holds.

The state per ticker is what the recursions need and nothing else: number of bars, last
date, the last 19 closes, and the two smoothed averages. Two tables hold it: the state after
the newest bar of each ticker, and the state at the end of each period, a month of daily
bars or a day of intraday ones. A batch that appends in order reads the newest states and
its own bars. For a ticker whose bars come late or again, the state at the end of the period
before the first of them still holds, whatever came since; the bars from there on are read
and computed again, and what follows from them replaces the earlier rows and states. The
last delivery of a bar wins.

All tables are versioned by batch (``streaming.versions``): a batch adds a part of what it
changes, parts are merged level by level, and a replayed batch rewrites its own part.

A batch is computed with the same block operators as a full run: a ticker that dominates
the stream is still spread over many tasks, which per-key state functions cannot do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.numeric import round_even
from ledgerline.operators.dedup import keep_last
from ledgerline.operators.indicators import KEYS
from ledgerline.operators.series import (
    HALO,
    INDEX,
    Ewm,
    Layout,
    block_window,
    cut,
    ewm_mean,
    fitting,
)
from ledgerline.session import stored
from ledgerline.streaming.versions import Versioned, add, compact, newest, part

TAIL = 19
PERIODS = 14
STATE = "bars bigint, last_date timestamp_ntz, tail array<double>, avg_gain double, avg_loss double"
TICK_SCHEMA = "ticker string, trading_date timestamp_ntz, close_price double"
RESULT = "return_pct double, ma20 double, rsi_14 double"
BAR_KEYS = ("ticker", "trading_date")


@dataclass(frozen=True)
class Online:
    """The tables of one online job.

    ``extra`` names more columns of a bar and their types; ``grain`` is the period at whose end
    states are kept, "month" or "day".
    """

    out: str
    extra: tuple[tuple[str, str], ...] = ()
    grain: str = "month"

    @property
    def bar_schema(self) -> str:
        return ", ".join([TICK_SCHEMA, *(f"{n} {t}" for n, t in self.extra)])

    @property
    def bars(self) -> Versioned:
        return Versioned(f"{self.out}/bars", self.bar_schema, BAR_KEYS)

    @property
    def rows(self) -> Versioned:
        """Results, and with them the closes a batch went on from, which are no results."""
        inner = "position bigint, avg_gain double, avg_loss double, is_old boolean"
        return Versioned(f"{self.out}/rows", f"{self.bar_schema}, {RESULT}, {inner}", BAR_KEYS, "NOT is_old")

    @property
    def current(self) -> Versioned:
        return Versioned(f"{self.out}/current", f"ticker string, {STATE}", ("ticker",))

    @property
    def periods(self) -> Versioned:
        return Versioned(f"{self.out}/periods", f"ticker string, period date, {STATE}", ("ticker", "period"))

    def period_of(self, date: str) -> Column:
        return F.to_date(date) if self.grain == "day" else F.trunc(F.to_date(date), "month")

    @property
    def tables(self) -> list[Versioned]:
        return [self.bars, self.rows, self.current, self.periods]


def _state() -> Column:
    return F.struct("bars", "last_date", "tail", "avg_gain", "avg_loss").alias("state")


def starting_points(spark: SparkSession, online: Online, bars: DataFrame, batch: int) -> DataFrame:
    """Per ticker of the batch: its first date here, whether that lies behind, and the newest state."""
    first = bars.groupBy("ticker").agg(F.min("trading_date").alias("starts_at"))
    now = newest(spark, online.current, batch, only=first.select("ticker")).select("ticker", _state())
    goes_back = F.coalesce(F.col("state.last_date") >= F.col("starts_at"), F.lit(False))
    return first.join(now, "ticker", "left").select("ticker", "starts_at", goes_back.alias("goes_back"), "state")


def earlier_states(spark: SparkSession, online: Online, back: DataFrame, batch: int) -> DataFrame:
    """For tickers that go back the state at the end of the last period before their first date."""
    kept = newest(spark, online.periods, batch, only=back.select("ticker"))
    starts = back.select("ticker", online.period_of("starts_at").alias("_starts_in"))
    before = kept.join(starts, "ticker").filter(F.col("period") < F.col("_starts_in"))
    held = before.groupBy("ticker").agg(F.max_by(_state(), "period").alias("state"))
    return back.drop("state").join(held, "ticker", "left").select(*back.columns)


def bars_again(
    spark: SparkSession, online: Online, bars: DataFrame, back: DataFrame, batch: int, since: str
) -> DataFrame:
    """The batch's bars, and those of earlier batches behind the states that tickers go back to.

    ``since`` is the oldest date needed: a literal, so it reaches the scan.
    """
    lower = F.col("state.last_date").alias("_since")
    stored_bars = newest(spark, online.bars, batch, only=back.select("ticker"))
    again = stored_bars.filter(F.col("trading_date") > F.lit(since).cast("timestamp_ntz"))
    again = again.join(back.select("ticker", lower), "ticker").filter(
        F.col("_since").isNull() | (F.col("trading_date") > F.col("_since"))
    )
    both = again.drop("_since").withColumn("_new", F.lit(0)).unionByName(bars.withColumn("_new", F.lit(1)))
    return keep_last(both, list(BAR_KEYS), "_new")


def continue_series(
    bars: DataFrame,
    state: DataFrame,
    layout: Layout = Layout(grain="day"),
    extra: tuple[tuple[str, str], ...] = (),
) -> DataFrame:
    """Indicators of new bars, with the columns the next state is made of.

    The state's closes go in front of the new bars as old rows. The newest old row holds
    the smoothed averages and seeds their recursion with full weight, so the first new bar
    continues it.
    """
    tails = state.select(
        "*", F.size("tail").alias("_n"), F.posexplode("tail").alias("_i", "close_price")
    )
    last = F.col("_i") == F.col("_n") - 1
    old = tails.select(
        "ticker",
        F.col("last_date").alias("trading_date"),
        # Old rows keep their order just before the last date; new bars are later.
        F.expr("last_date + make_dt_interval(0, 0, 0, (_i + 1 - _n) / 1000000.0)").alias("_at"),
        "close_price",
        F.when(last, F.col("avg_gain")).otherwise(0.0).alias("_old_gain"),
        F.when(last, F.col("avg_loss")).otherwise(0.0).alias("_old_loss"),
        F.lit(True).alias("_old"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in extra],
    )
    nothing = F.lit(None).cast("double")
    new = bars.select(
        "ticker",
        "trading_date",
        F.col("trading_date").alias("_at"),
        "close_price",
        nothing.alias("_old_gain"),
        nothing.alias("_old_loss"),
        F.lit(False).alias("_old"),
        *[name for name, _ in extra],
    )
    tail = F.size("tail")
    starts = state.select(
        "ticker",
        (F.col("bars") - tail).alias("_skipped"),
        # After a single bar there is no average yet: the second bar seeds it.
        F.when(F.col("bars") > 1, tail - 1).alias("_seeded"),
    )

    def moves(rows: DataFrame) -> DataFrame:
        change = F.col("close_price") - F.col("_prev")
        return rows.join(starts, "ticker", "left").select(
            *rows.columns,
            (F.col(INDEX) + F.coalesce("_skipped", F.lit(0))).alias("_position"),
            F.coalesce("_seeded", F.lit(1)).alias("_seed"),
            F.when(F.col("_old"), F.col("_old_gain")).otherwise(F.greatest(change, F.lit(0.0))).alias("_gain"),
            F.when(F.col("_old"), F.col("_old_loss")).otherwise(F.greatest(-change, F.lit(0.0))).alias("_loss"),
            ((F.try_divide("close_price", "_prev") - 1) * 100).alias("_return"),
        )

    pieces = cut(
        old.unionByName(new),
        KEYS,
        "_at",
        fitting(layout, [1 / PERIODS]),
        halo=TAIL,
        lags={"_prev": "close_price"},
        derive=moves,
    )
    rows = pieces.rows.withColumn("_ma20", F.avg("close_price").over(block_window(KEYS, TAIL)))
    specs = [
        Ewm("avg_gain", "_gain", 1 / PERIODS, seed_at="_seed"),
        Ewm("avg_loss", "_loss", 1 / PERIODS, seed_at="_seed"),
    ]
    smoothed = ewm_mean(rows, pieces, specs).filter(~F.col(HALO))
    strength = F.try_divide("avg_gain", "avg_loss")
    position = F.col("_position")
    rsi = F.when(
        position >= PERIODS, F.coalesce(100 - F.lit(100.0) / (1 + strength), F.lit(100.0))
    )
    return smoothed.select(
        "ticker",
        "trading_date",
        "close_price",
        *[name for name, _ in extra],
        round_even("_return", 4).alias("return_pct"),
        round_even("_ma20", 4).alias("ma20"),
        round_even(rsi, 4).alias("rsi_14"),
        position.alias("position"),
        "avg_gain",
        "avg_loss",
        F.col("_old").alias("is_old"),
    )


def period_states(rows: DataFrame, online: Online) -> DataFrame:
    """The state at the end of each period that the rows of a batch reach into.

    The rank limit works on the map side: a period sends at most 19 rows per task. Closes of
    earlier ones are taken over where a period has fewer; that window is as long as the calendar.
    """
    placed = rows.withColumn("period", online.period_of("trading_date"))
    last = Window.partitionBy("ticker", "period").orderBy(F.col("position").desc())
    ends = placed.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= TAIL)
    closes = F.array_sort(F.collect_list(F.struct("position", "close_price")))
    states = ends.groupBy("ticker", "period").agg(
        (F.max("position") + 1).alias("bars"),
        F.max("trading_date").alias("last_date"),
        F.transform(closes, lambda t: t["close_price"]).alias("_own"),
        F.max_by("avg_gain", "position").alias("avg_gain"),
        F.max_by("avg_loss", "position").alias("avg_loss"),
    )
    behind = Window.partitionBy("ticker").orderBy("period").rowsBetween(1 - TAIL, 0)
    known = F.flatten(F.collect_list("_own").over(behind))
    joined = states.withColumn("_known", known)
    first = F.greatest(F.size("_known") - TAIL, F.lit(0)) + 1
    return joined.withColumn("tail", F.slice("_known", first, TAIL)).select(
        "ticker", "period", "bars", "last_date", "tail", "avg_gain", "avg_loss"
    )


def online_batch(
    spark: SparkSession, ticks: DataFrame, batch: int, online: Online, layout: Layout = Layout(grain="day")
) -> None:
    """Compute one micro-batch; store its bars, its rows and the states after it.

    ``_order``, if the ticks have it, says which delivery of a bar is the last.
    """
    for table in online.tables:
        compact(spark, table, batch)
    ordered = ticks if "_order" in ticks.columns else ticks.withColumn("_order", F.monotonically_increasing_id())
    names = ["ticker", "trading_date", "close_price", *(n for n, _ in online.extra)]
    add(online.bars, keep_last(ordered, list(BAR_KEYS), "_order").select(*names), batch)
    bars = part(spark, online.bars, batch)
    starts = stored(spark, starting_points(spark, online, bars, batch), "starts")
    back = starts.filter("goes_back")
    needed = bars
    if not back.isEmpty():
        back = stored(spark, earlier_states(spark, online, back, batch), "back")
        start = F.coalesce("state.last_date", F.lit("0001-01-01").cast("timestamp_ntz"))
        since = back.agg(F.min(start).cast("string")).first()[0]
        # Read several times below.
        needed = stored(spark, bars_again(spark, online, bars, back, batch, since), "needed")
        starts = starts.filter("not goes_back").unionByName(back)
    state = starts.filter(F.col("state").isNotNull()).select("ticker", "state.*")
    add(online.rows, continue_series(needed, state, layout, online.extra), batch)
    add(online.periods, period_states(part(spark, online.rows, batch), online), batch)
    ends = part(spark, online.periods, batch).groupBy("ticker").agg(F.max_by(_state(), "period").alias("state"))
    add(online.current, ends.select("ticker", "state.*"), batch)


def ticks_of(out: str) -> Online:
    """The tables of intraday closes."""
    return Online(out, grain="day")


def indicator_batch(
    spark: SparkSession, ticks: DataFrame, batch_id: int, out: str, layout: Layout = Layout(grain="day")
) -> None:
    """One micro-batch of ticks with a close each."""
    online_batch(spark, ticks, batch_id, ticks_of(out), layout)


def indicator_stream_job(spark: SparkSession, ticks_root: str, out: str) -> None:
    """Process the tick files not seen yet, then stop."""
    (
        spark.readStream.schema(TICK_SCHEMA)
        .option("recursiveFileLookup", True)
        .parquet(ticks_root)
        .withColumn("_order", F.struct("_metadata.file_path", "_metadata.row_index"))
        .writeStream.foreachBatch(lambda df, i: indicator_batch(df.sparkSession, df, i, out))
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def read_online(spark: SparkSession, online: Online) -> DataFrame:
    """The result so far: of rows computed again the last ones count."""
    return newest(spark, online.rows).drop("position", "avg_gain", "avg_loss", "is_old")


def read_indicators(spark: SparkSession, out: str) -> DataFrame:
    return read_online(spark, ticks_of(out))
