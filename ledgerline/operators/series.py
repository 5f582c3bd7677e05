"""Ordered computations over long series without one task per series.

``Window.partitionBy("ticker")`` puts a whole ticker into one task, which fails
as soon as one ticker holds a large part of the table. The helpers here cut every
series into pieces that are bounded whatever the key distribution:

* ``running_sums`` / ``indexed``: the series is cut by a coarse monotone bin
  (calendar bin, value bin). Per-bin totals are pre-aggregated on the map side,
  their prefix sums give each bin's offset, and rows are only ordered inside a bin.
* ``in_blocks``: rows with a global index are cut into blocks of ``size`` rows. The
  last ``halo`` rows of a block are copied in front of the next one, so any frame
  that looks back at most ``halo`` rows is computed inside a block, exactly.
* ``ewm_mean``: recursion ``y[t] = q*y[t-1] + a*x[t]`` in closed form inside a block,
  plus the state carried over from earlier blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.times import calendar_bin

INDEX = "row_idx"
BLOCK = "row_block"
HALO = "in_halo"

BLOCK_ROWS = 1024


def running_sums(
    df: DataFrame, keys: list[str], order: list[Column], bin_col: str, sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums per key in ``order``; ``bin_col`` must not decrease along it."""
    group = [*keys, bin_col]
    totals = df.groupBy(*group).agg(*[F.sum(e).alias(f"_{n}") for n, e in sums.items()])
    # One row per bin: as long as the calendar or the splitter list, not as the data.
    earlier = (
        Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *group, *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums]
    )
    inside = (
        Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return df.join(offsets, group).select(
        *[df[c] for c in df.columns],
        *[(F.sum(e).over(inside) + F.col(f"_{n}")).alias(n) for n, e in sums.items()],
    )


def indexed(
    df: DataFrame, keys: list[str], order: str, bin_col: str, lags: dict[str, str] | None = None
) -> DataFrame:
    """Add the 0-based position of each row in its series, and previous-row values.

    ``lags`` maps new column names to the columns they take from the previous row; the
    first row of a bin takes them from the end of the bin before it.
    """
    lags = lags or {}
    group = [*keys, bin_col]
    totals = df.groupBy(*group).agg(
        F.count("*").alias("_rows"),
        *[F.max_by(c, order).alias(f"_last_{n}") for n, c in lags.items()],
    )
    bins = Window.partitionBy(*keys).orderBy(bin_col)
    earlier = bins.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.lag(f"_last_{n}").over(bins).alias(f"_last_{n}") for n in lags],
    )
    inside = Window.partitionBy(*group).orderBy(order)
    position = F.row_number().over(inside)
    return df.join(offsets, group).select(
        *[df[c] for c in df.columns],
        (position - 1 + F.col("_before")).cast("long").alias(INDEX),
        *[
            F.when(position == 1, F.col(f"_last_{n}")).otherwise(F.lag(c).over(inside)).alias(n)
            for n, c in lags.items()
        ],
    )


def in_blocks(indexed_rows: DataFrame, size: int = BLOCK_ROWS, halo: int = 0) -> DataFrame:
    """Add BLOCK and HALO; rows near a block's end are repeated ahead of the next block."""
    if halo > size:
        raise ValueError(f"a look-back of {halo} rows needs blocks of at least that size")
    block = F.floor(F.col(INDEX) / size).cast("long")
    own = F.struct(block.alias(BLOCK), F.lit(False).alias(HALO))
    if halo == 0:
        return indexed_rows.select("*", block.alias(BLOCK), F.lit(False).alias(HALO))
    ahead = F.struct((block + 1).alias(BLOCK), F.lit(True).alias(HALO))
    near_end = F.pmod(F.col(INDEX), F.lit(size)) >= size - halo
    copies = F.when(near_end, F.array(own, ahead)).otherwise(F.array(own))
    return indexed_rows.select("*", F.inline(copies))


@dataclass(frozen=True)
class Layout:
    """How series are cut into tasks.

    ``grain`` bounds how many rows of one key are ordered together while they are
    numbered: a month of daily bars; intraday series should say "day". ``size`` is the
    number of rows per block.
    """

    grain: str = "month"
    size: int = BLOCK_ROWS


@dataclass(frozen=True)
class Cut:
    """Rows with INDEX, BLOCK and HALO, and the numbered rows they were cut from."""

    rows: DataFrame
    source: DataFrame
    keys: list[str]
    size: int


def cut(
    df: DataFrame,
    keys: list[str],
    order: str,
    layout: Layout = Layout(),
    *,
    halo: int = 0,
    lags: dict[str, str] | None = None,
    derive=lambda rows: rows,
) -> Cut:
    """Number the rows of each series and cut it into bounded pieces.

    ``lags`` are previous-row columns, ``derive`` adds columns computed row by row from
    them.
    """
    binned = df.withColumn("_bin", calendar_bin(F.col(order), layout.grain))
    source = derive(indexed(binned, keys, order, "_bin", lags or {}).drop("_bin"))
    return Cut(in_blocks(source, layout.size, halo), source, keys, layout.size)


def block_window(keys: list[str], preceding: int | None = None):
    """Rows of a block in series order: the last ``preceding`` + 1 rows, or all so far."""
    start = Window.unboundedPreceding if preceding is None else -preceding
    return Window.partitionBy(*keys, BLOCK).orderBy(INDEX).rowsBetween(start, 0)


@dataclass(frozen=True)
class Ewm:
    """``out`` = unadjusted exponential mean of ``value``.

    The row at index ``start`` seeds the recursion with full weight, earlier rows do not
    count; ``seed_at`` names a column that says so per row instead. The result is null
    before ``min_periods`` observations.
    """

    out: str
    value: str
    alpha: float
    start: int = 0
    min_periods: int = 1
    seed_at: str | None = None


# Powers in the closed form stay within e^600, inside double range.
_MOST_DECAY = 600.0


def fitting(layout: Layout, alphas: list[float]) -> Layout:
    """The layout with blocks short enough for exponential means of these alphas."""
    most = int(min(_MOST_DECAY / -math.log(1 - a) for a in alphas))
    return replace(layout, size=min(layout.size, most))


def _power(base: float, exponent: Column) -> Column:
    return F.pow(F.lit(base), exponent.cast("double"))


def _weighted(spec: Ewm) -> Column:
    """Observation times its weight; the first one seeds the recursion with weight 1."""
    seed = F.col(spec.seed_at) if spec.seed_at else F.lit(spec.start)
    weight = F.when(F.col(INDEX) == seed, F.lit(1.0)).otherwise(F.lit(spec.alpha))
    return F.when(F.col(INDEX) >= seed, F.col(spec.value) * weight)


def _carry(ends: DataFrame, keys: list[str], specs: list[Ewm], size: int) -> DataFrame:
    """Per block the state that earlier blocks hand over.

    A block's closing value reaches the j-th later block with weight ``q^(size*(j-1))``;
    j runs until that factor leaves the double range, so nothing a sequential recursion
    would still see is cut off.
    """
    reach = max(math.ceil(700 / (-math.log(1 - s.alpha) * size)) for s in specs)
    step = F.col("_step")
    sums = [
        F.sum(F.col(f"_l_{s.out}") * _power((1 - s.alpha) ** size, step - 1)).alias(f"_c_{s.out}")
        for s in specs
    ]
    return (
        ends.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(reach))))
        .groupBy(*keys, (F.col(BLOCK) + step).alias(BLOCK))
        .agg(*sums)
    )


def ewm_mean(rows: DataFrame, cut: Cut, specs: list[Ewm], from_source: bool = True) -> DataFrame:
    """Add one column per spec to cut rows (``cut.rows`` or what was derived from them).

    Inside a block ``y[i] = q^i * sum(w*x*q^-i)``, where i < ``size`` keeps the powers in
    double range. Blocks are counted from index 0, so a series that starts later just
    begins inside a block.

    The values to smooth normally sit on ``cut.source`` too: then closing values are a
    plain sum per block that combines on the map side. Values that are themselves results
    per block (``from_source`` false) are read off the block ends instead.
    """
    keys, size = cut.keys, cut.size
    index, block = F.col(INDEX), F.col(BLOCK)
    within = index - block * size
    upto = block_window(keys)
    for s in specs:
        if -math.log(1 - s.alpha) * size > _MOST_DECAY:
            raise ValueError(f"blocks of {size} rows are too long for alpha={s.alpha}")

    def local_value(s: Ewm) -> Column:
        term = F.when(~F.col(HALO), _weighted(s) * _power(1 - s.alpha, -within))
        return F.coalesce(F.sum(term).over(upto), F.lit(0.0)) * _power(1 - s.alpha, within)

    local = rows.select("*", *[local_value(s).alias(f"_l_{s.out}") for s in specs])

    def result(s: Ewm, value: Column) -> Column:
        return F.when(index >= s.start + s.min_periods - 1, value).alias(s.out)

    if from_source:
        closing = [
            F.sum(_weighted(s) * _power(1 - s.alpha, size - 1 - within)).alias(f"_l_{s.out}")
            for s in specs
        ]
        ends = (
            cut.source.withColumn(BLOCK, F.floor(index / size).cast("long"))
            .groupBy(*keys, BLOCK)
            .agg(F.max(within).alias("_last"), *closing)
            .filter(F.col("_last") == size - 1)
        )
    else:
        ends = local.filter(~F.col(HALO) & (within == size - 1)).select(
            *keys, BLOCK, *[f"_l_{s.out}" for s in specs]
        )
    joined = local.join(_carry(ends, keys, specs, size), [*keys, BLOCK], "left")

    def carried(s: Ewm) -> Column:
        handed = _power(1 - s.alpha, within + 1) * F.coalesce(F.col(f"_c_{s.out}"), F.lit(0.0))
        return F.col(f"_l_{s.out}") + handed

    return joined.select(*[rows[c] for c in rows.columns], *[result(s, carried(s)) for s in specs])
