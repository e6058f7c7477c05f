"""The tradable universe and instrument lookups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schemas import STOCK_LIST
from barloom.sources.store import TableStore

# fixed values: exchange, segment and the symbol form of bonds and series codes
EXCHANGE = "NSE"
SEGMENT = "NSE"
SERIES_CODE = r"^\d.*-.{2}$"


def universe_filter(instruments: DataFrame, as_of: date) -> DataFrame:
    """Instruments of the exchange's cash segment without bond and series codes, stamped with a date."""
    kept = instruments.filter(
        (F.col("exchange") == EXCHANGE)
        & (F.col("segment") == SEGMENT)
        & ~F.col("tradingsymbol").rlike(SERIES_CODE)
    )
    return kept.withColumn("Date_Update", F.lit(as_of)).select(*STOCK_LIST.fieldNames())


def universe_snapshot(store: TableStore, instruments: DataFrame, as_of: date) -> DataFrame:
    """Replace ``stock_list`` with today's universe and return the stored table."""
    store.replace("stock_list", universe_filter(instruments, as_of))
    return store.read("stock_list")


def instrument_lookup(requests: DataFrame, instruments: DataFrame) -> DataFrame:
    """Token of each requested (tradingsymbol, exchange); unknown ones have ``found = false``.

    A frame has no first row, so of several matches the lowest token counts.
    """
    keys = ["tradingsymbol", "exchange"]
    tokens = instruments.groupBy(*keys).agg(F.min("instrument_token").alias("instrument_token"))
    return (
        requests.select(*keys)
        .join(tokens, keys, "left")
        .withColumn("found", F.col("instrument_token").isNotNull())
    )
