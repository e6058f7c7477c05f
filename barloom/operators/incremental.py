"""Indicators that a day extends by a day.

``indicator_state`` has one row per symbol: how many bars it has, the newest of them, the three exponential averages, the
running volume and the last bars as an array. New bars are laid out behind those last bars, so look-back windows see what
they need, and running values start from the stored ones. The work of a day grows with the symbols and their new
bars, not with their history, which is neither read nor written again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import (
    CHUNK_ROWS,
    CONTEXT,
    DATE,
    OFFSET,
    POS,
    SYMBOL,
    ExtensionFrame,
    longest_series,
    number_rows,
)
from barloom.operators.indicators import FAST_END, HISTORY, SLOW_END, all_steps, with_carries
from barloom.schemas import INDICATOR_STATE, STOCK_INDICATORS, STOCK_LATEST, STOCK_TIMESERIES
from barloom.session import cut_lineage
from barloom.sources.store import TableStore

BAR = [name for name in STOCK_TIMESERIES.fieldNames() if name not in (SYMBOL, DATE)]
KEY = [SYMBOL, DATE]
# whether a row is among the last bars of its symbol, which the state keeps
TAIL = "_tail"


def newer_bars(bars: DataFrame, state: DataFrame) -> DataFrame:
    """The bars behind the newest one that a symbol's state knows."""
    known = state.select(SYMBOL, "max_date")
    rows = bars.select(SYMBOL, DATE, *BAR).join(known, SYMBOL, "left")
    return rows.filter(F.col("max_date").isNull() | (F.col(DATE) > F.col("max_date"))).drop("max_date")


def extended_rows(fresh: DataFrame, state: DataFrame | None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The new bars with their indicators, and the last bars before them (``CONTEXT``) without.

    ``fresh`` holds at most ``chunk_rows`` bars of a symbol, all newer than its state, one per date. Without a ``state`` they
    are the first ones: one shuffle lays them out.
    """
    both = _first_rows(fresh) if state is None else _rows_behind(fresh, state)
    frame = ExtensionFrame(both, chunk_rows, True)
    in_tail = {TAIL: F.lead(POS, HISTORY).over(frame.window).isNull()}
    frame = frame.with_steps([in_tail], *all_steps(frame))
    kept = [*STOCK_LATEST.fieldNames(), FAST_END, SLOW_END, CONTEXT, TAIL]
    return with_carries(frame, frame.df).select(*kept)


def _numbered(fresh: DataFrame) -> DataFrame:
    order = Window.partitionBy(SYMBOL).orderBy(DATE)
    return fresh.select(SYMBOL, DATE, *BAR).withColumn(OFFSET, F.row_number().over(order).cast("long") - 1)


def _first_rows(fresh: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("struct<fast: double, slow: double, signal: double>")
    return _numbered(fresh).withColumns(
        {POS: F.col(OFFSET), CONTEXT: F.lit(False), "_obv_carry": F.lit(None).cast("double"), "_macd_carry": nothing}
    )


def _rows_behind(fresh: DataFrame, state: DataFrame) -> DataFrame:
    """The new bars numbered on from their symbol's state, and the last bars it keeps of the symbols that have any."""
    carried = state.select(
        SYMBOL, "n_rows", F.col("obv").alias("_obv_carry"), F.struct("fast", "slow", "signal").alias("_macd_carry")
    )
    new = (
        _numbered(fresh)
        .join(carried, SYMBOL, "left")
        .withColumn(POS, F.coalesce(F.col("n_rows"), F.lit(0).cast("long")) + F.col(OFFSET))
        .withColumn(CONTEXT, F.lit(False))
    )
    touched = state.join(fresh.select(SYMBOL).distinct(), SYMBOL, "left_semi")
    before = touched.select(SYMBOL, "n_rows", F.size("tail").alias("_size"), F.posexplode("tail").alias("_at", "_bar"))
    context = before.select(
        SYMBOL, F.col("_bar.date").alias(DATE), *[F.col(f"_bar.{name}").alias(name) for name in BAR],
        (F.col("_at") - F.col("_size")).cast("long").alias(OFFSET),
        (F.col("n_rows") + F.col("_at") - F.col("_size")).alias(POS), F.lit(True).alias(CONTEXT),
    )
    return new.drop("n_rows").unionByName(context, allowMissingColumns=True)


def extended_state(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state and the last row of every symbol among ``rows``, from the last bars of each alone."""
    bar = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INDICATOR_STATE["tail"].dataType.elementType.fields])

    def last(name: str) -> F.Column:
        return F.max_by(name, DATE)

    ends = rows.filter(TAIL).groupBy(SYMBOL).agg(
        (F.max(POS) + 1).alias("n_rows"),
        F.max(DATE).alias("max_date"),
        last(FAST_END).alias("fast"),
        last(SLOW_END).alias("slow"),
        last("MACD_signal").alias("signal"),
        last("OBV").alias("obv"),
        F.sort_array(F.collect_list(bar)).alias("tail"),
        last(F.struct(*[c for c in STOCK_LATEST.fieldNames() if c != SYMBOL])).alias("row"),
    )
    found = cut_lineage(ends, "extended-state")
    return found.select(*INDICATOR_STATE.fieldNames()), found.select(SYMBOL, "row.*")


def upserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with the symbols of ``rows`` replaced."""
    kept = table.join(rows.select(SYMBOL), SYMBOL, "left_anti")
    return kept.unionByName(rows.select(*table.columns))


def extend_indicators(store: TableStore, bars: DataFrame, chunk_rows: int = CHUNK_ROWS) -> None:
    """Take ``bars`` into ``stock_indicators``, ``stock_latest`` and ``indicator_state``.

    Bars that are not newer than their symbol's state are passed over. A first load, or any other of more than ``chunk_rows``
    bars of a symbol, is taken in in slices of so many. The state is published last: a run that fails before is
    repeated with the same result, for rows that are there are not appended again.

    The rows are computed twice, for the table and for the state, because that moves a fraction of what writing all of
    them beside the table would. ``bars`` of a first load should be stored rows: they are read for each of these.
    """
    first = not store.exists("indicator_state")
    fresh = bars.select(SYMBOL, DATE, *BAR) if first else cut_lineage(newer_bars(bars, store.read("indicator_state")), "fresh-bars")
    longest = longest_series(fresh)
    parts = [fresh]
    if longest > chunk_rows:
        numbered = cut_lineage(number_rows(fresh), "fresh-numbered")
        slices = range(math.ceil(longest / chunk_rows))
        parts = [numbered.filter(F.floor(F.col(POS) / chunk_rows) == n) for n in slices]
    for part in parts if longest else []:
        state, latest = store.read("indicator_state"), store.read("stock_latest")
        rows = extended_rows(part, state if store.exists("indicator_state") else None, chunk_rows)
        own = rows.filter(~F.col(CONTEXT)).select(*STOCK_INDICATORS.fieldNames())
        store.append_missing("stock_indicators", own, KEY, dates=part, gather=not first)
        new_state, new_latest = extended_state(rows)
        store.replace("stock_latest", upserted(latest, new_latest))
        store.replace("indicator_state", upserted(state, new_state))


def maintained_latest(store: TableStore) -> DataFrame:
    """The last bar of each symbol, kept up to date; symbols with one bar only are left out."""
    return store.read("stock_latest").filter(F.col(POS) >= 1)
