"""Windows over keyed series, whole or in chunks.

A bar table holds one row per (tradingsymbol, date). As long as the longest series has at most
``CHUNK_ROWS`` rows (checked by counting rows per symbol) every series is one window partition of bounded size:
one shuffle, one sort. Beyond that the series are cut into chunks of ``CHUNK_ROWS`` rows, so that no
task ever holds more than a chunk of any symbol, however many of the table's rows that symbol has:

* ``pos``, the ordinal of a row in its series, comes from row counts per (symbol, year) plus
  ``row_number`` inside a year;
* a chunk also receives the last ``history`` rows of the chunk before it, as context, so look-back
  windows see what they need; the rows of a year and chunk are sent there packed, since rows of their own take
  almost three times the disk;
* values that reach back to the start of a series (running sums, exponential averages) are computed
  per chunk and completed with a carry (see ``operators.indicators``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio_change

SYMBOL, DATE, POS = "tradingsymbol", "date", "pos"
CHUNK, CONTEXT, TOTAL, OFFSET, YEAR = "_chunk", "_context", "_n_rows", "_offset", "_year"

CHUNK_ROWS = 1024

Steps = list[dict[str, Column]]


@dataclass(frozen=True)
class SeriesFrame:
    """Bars with ``pos``, laid out so that ``window`` never spans more than a chunk."""

    df: DataFrame
    chunk_rows: int
    chunked: bool

    @property
    def keys(self) -> list[str]:
        return [SYMBOL, CHUNK] if self.chunked else [SYMBOL]

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy(DATE)

    @property
    def offset(self) -> Column:
        """Ordinal of a row inside its chunk."""
        return F.col(POS) % F.lit(self.chunk_rows) if self.chunked else F.col(POS)

    @property
    def own(self) -> Column:
        """False for the context rows of a chunk."""
        return ~F.col(CONTEXT) if self.chunked else F.lit(True)

    def with_steps(self, *indicators: Steps) -> SeriesFrame:
        """Add the columns of several indicators, step by step.

        Step ``n`` of all indicators is added at once, so columns that need the same number of nested
        windows share one window pass.
        """
        df = self.df
        for columns in zip_longest(*indicators, fillvalue={}):
            merged = {name: value for part in columns for name, value in part.items()}
            if merged:
                df = df.withColumns(merged)
        return replace(self, df=df)

    def previous(self, column: Column | str, rows: int = 1) -> Column:
        return F.lag(column, rows).over(self.window)

    def change(self, column: str, rows: int = 1) -> Column:
        return ratio_change(F.col(column), self.previous(column, rows))

    def rolling(
        self,
        aggregate: Callable[[Column], Column],
        column: str,
        rows: int,
        first: int | None = None,
    ) -> Column:
        """Aggregate of the last ``rows`` values; NULL until that many non-null ones are there.

        ``first`` is the position from which ``column`` is never NULL; without it values are counted.
        """
        frame = self.window.rowsBetween(-(rows - 1), 0)
        value = F.col(column)
        full = F.count(value).over(frame) == rows if first is None else F.col(POS) >= first + rows - 1
        return F.when(full, aggregate(value).over(frame))

    def part(self, aggregate: Callable[[Column], Column], column: str, rows: int) -> Column:
        """Aggregate of the last ``rows`` values, 0 over none: one part of a longer look-back (see ``over_parts``)."""
        value = aggregate(F.col(column)).over(self.window.rowsBetween(-(rows - 1), 0))
        return F.coalesce(value.cast("double"), F.lit(0.0))

    def over_parts(self, column: str, rows: int, parts: int) -> Column:
        """Sum of a part of ``rows`` rows and of those before it, ``parts`` in all.

        Spark computes a sliding frame anew for each row, at the cost of its length. Parts of a few rows, and lags of
        them, cost a fraction of that; nothing is subtracted, so no digits are lost. Rows before the first count as 0.
        """
        earlier = [F.lag(column, n * rows, 0.0).over(self.window) for n in range(parts - 1, 0, -1)]
        return reduce(Column.__add__, [*earlier, F.col(column)])

    def running_sum(self, value: Column, until: int = 0) -> Column:
        """Sum over the rows of the chunk so far, context rows left out."""
        frame = self.window.rowsBetween(Window.unboundedPreceding, until)
        if self.chunked:
            value = F.when(self.own, value).otherwise(F.lit(0.0))
        return F.sum(value).over(frame)

    def running_ema(self, value: Column, span: int) -> Column:
        """Exponential average with a zero start value at the chunk's first row.

        ``y[j] = q^j * sum(w[i] * x[i] * q^-i, i <= j)``: the recursion
        ``y[j] = (1 - q) * x[j] + q * y[j-1]`` as a running sum, where the first row of the series
        has weight 1 (its value seeds the average). The chunk size keeps ``q^-i`` finite.
        """
        decay = ema_decay(span)
        if decay**-self.chunk_rows > 1e250:
            raise ValueError(f"chunks of {self.chunk_rows} rows are too long for span {span}")
        weight = F.when(F.col(POS) == 0, F.lit(1.0)).otherwise(F.lit(1.0 - decay))
        scaled = weight * value * F.pow(F.lit(decay), -self.offset)
        return F.pow(F.lit(decay), self.offset) * self.running_sum(scaled)

    def rows(self) -> DataFrame:
        """The frame without context rows."""
        return self.df.filter(self.own) if self.chunked else self.df


@dataclass(frozen=True)
class ExtensionFrame(SeriesFrame):
    """New rows of each series behind the last rows of what is known of it; ``OFFSET`` counts the new ones."""

    @property
    def keys(self) -> list[str]:
        return [SYMBOL]

    @property
    def offset(self) -> Column:
        return F.col(OFFSET)


def ema_decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def carry_depth(span: int, chunk_rows: int) -> int:
    """How many chunks back an exponential average still differs from 0 in double precision."""
    return max(2, math.ceil(745.0 / (-math.log(ema_decay(span)) * chunk_rows)))


def longest_series(bars: DataFrame) -> int:
    """Rows of the longest series: a count per symbol, combined before its shuffle."""
    counts = bars.groupBy(SYMBOL).agg(F.count(F.lit(1)).alias("rows"))
    return counts.agg(F.max("rows")).first()[0] or 0


def _numbered_by_year(bars: DataFrame) -> DataFrame:
    """As ``number_rows``, with ``YEAR``; rows of a symbol and year are in one partition."""
    years = bars.groupBy(SYMBOL, F.year(DATE).alias(YEAR)).agg(F.count(F.lit(1)).alias("_rows"))
    series = Window.partitionBy(SYMBOL)
    so_far = series.orderBy(YEAR).rowsBetween(Window.unboundedPreceding, 0)
    starts = years.select(
        SYMBOL,
        YEAR,
        (F.sum("_rows").over(so_far) - F.col("_rows")).alias("_start"),
        F.sum("_rows").over(series).alias(TOTAL),
    )
    in_year = Window.partitionBy(SYMBOL, YEAR).orderBy(DATE)
    return (
        bars.withColumn(YEAR, F.year(DATE))
        .join(starts, [SYMBOL, YEAR])
        .withColumn(POS, F.col("_start") + F.row_number().over(in_year) - 1)
        .drop("_start")
    )


def number_rows(bars: DataFrame) -> DataFrame:
    """Add ``pos`` (0-based ordinal by date) and the series length without a whole-series window."""
    return _numbered_by_year(bars).drop(YEAR)


def in_chunks(numbered: DataFrame, history: int, chunk_rows: int = CHUNK_ROWS) -> SeriesFrame:
    """Send each row to its chunk, and the last ``history`` rows of a chunk also to the next one."""
    if history >= chunk_rows:
        raise ValueError("a chunk must be longer than the look-back")
    own = F.floor(F.col(POS) / F.lit(chunk_rows))
    is_tail = F.col(POS) % chunk_rows >= chunk_rows - history
    has_next = (own + 1) * chunk_rows < F.col(TOTAL)
    targets = F.when(is_tail & has_next, F.array(own, own + 1)).otherwise(F.array(own))
    if YEAR not in numbered.columns:
        numbered = numbered.withColumn(YEAR, F.year(DATE))
    kept = [name for name in numbered.columns if name not in (SYMBOL, YEAR)]
    packed = (
        numbered.withColumn(CHUNK, F.explode(targets))
        .groupBy(SYMBOL, YEAR, CHUNK)
        .agg(F.collect_list(F.struct(*kept)).alias("_packed"))
    )
    df = packed.drop(YEAR).repartition(SYMBOL, CHUNK).select(SYMBOL, CHUNK, F.inline("_packed"))
    df = df.withColumn(CONTEXT, F.col(CHUNK) > own).select(*numbered.drop(YEAR).columns, CHUNK, CONTEXT)
    return SeriesFrame(df, chunk_rows, True)


def whole_series(bars: DataFrame, chunk_rows: int = CHUNK_ROWS) -> SeriesFrame:
    """Every series in one window partition; only for series of at most ``chunk_rows`` rows."""
    order = Window.partitionBy(SYMBOL).orderBy(DATE)
    numbered = bars.withColumn(POS, F.row_number().over(order).cast("bigint") - 1)
    return SeriesFrame(numbered, chunk_rows, False)


def series_frame(
    bars: DataFrame,
    history: int,
    longest: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> SeriesFrame:
    """Lay ``bars`` out for windows that look back ``history`` rows.

    ``longest`` is the length of the longest series when the caller knows it; otherwise it is counted.
    """
    longest = longest_series(bars) if longest is None else longest
    if longest <= chunk_rows:
        return whole_series(bars, chunk_rows)
    return in_chunks(_numbered_by_year(bars), history, chunk_rows)
