"""Daily bars and their incremental load."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.store import TableStore


#: How far back a symbol without bars is loaded.
FIRST_LOAD_MONTHS = 3

#: How many symbols with older ranges than the others a tick scan names, and in how many groups.
LISTED_SYMBOLS = 1_000
SPANS = 8

#: Bar lengths by name, as the start of the bar that a time falls into.
INTERVALS = {
    "minute": lambda ts: F.date_trunc("minute", ts),
    "15minute": lambda ts: F.window(ts, "15 minutes")["start"],
    "60minute": lambda ts: F.date_trunc("hour", ts),
    "day": lambda ts: F.date_trunc("day", ts),
    "week": lambda ts: F.date_trunc("week", ts),
}


def interval_bars(ticks: DataFrame, interval: str, order_by: list[str] | None = None) -> DataFrame:
    """Bars of another length than a day, by ``start``; weeks begin on Monday."""
    key = tick_key(order_by)
    start = INTERVALS[interval](F.col("ts")).cast("timestamp_ntz")
    return ticks.groupBy("tradingsymbol", start.alias("start")).agg(*bar_values(key))


def tick_key(order_by: list[str] | None) -> Column:
    order_by = order_by or ["ts", "tick_id"]
    return F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)


def bar_values(key: Column) -> list[Column]:
    return [
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("quantity").alias("volume"),
    ]


def partial_bars(ticks: DataFrame) -> DataFrame:
    """Daily bars that can still be merged: open and close with the (ts, tick_id) they were traded at."""
    key = F.struct("ts", "tick_id")
    priced = ticks.filter(F.col("price").isNotNull())
    return priced.groupBy("tradingsymbol", F.to_date("ts").alias("date")).agg(
        *bar_values(key), F.min(key).alias("first_key"), F.max(key).alias("last_key")
    )


def merged_partials(partial: DataFrame) -> DataFrame:
    """One partial bar per symbol and day from any number of them, in whatever order they came."""
    return partial.groupBy("tradingsymbol", "date").agg(
        F.min_by("open", "first_key").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last_key").alias("close"),
        F.sum("volume").alias("volume"),
        F.min("first_key").alias("first_key"),
        F.max("last_key").alias("last_key"),
    )


def merged_bars(partial: DataFrame) -> DataFrame:
    """Whole daily bars from any number of partial ones."""
    return merged_partials(partial).drop("first_key", "last_key")


def daily_bars(ticks: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Open, high, low, close and volume per symbol and day.

    ``ticks`` has ``tradingsymbol, ts, price, quantity`` and the columns of ``order_by`` (default
    ``ts, tick_id``), which must order a symbol's ticks of a day without ties. Every aggregate is combined before the
    shuffle, so a symbol with any share of the ticks sends one row per day and task. A single
    ordering column keeps the aggregation hash-based; several need a struct key, which Spark
    aggregates by sorting. Ticks without a price make no bar, so a bar always has a close.
    """
    priced = ticks.filter(F.col("price").isNotNull())
    days = priced.groupBy("tradingsymbol", F.to_date("ts").alias("date"))
    return days.agg(*bar_values(tick_key(order_by)))


def ingest_watermark(stored: DataFrame) -> DataFrame:
    """Newest stored date per symbol."""
    return stored.groupBy("tradingsymbol").agg(F.max("date").alias("max_date"))


def ingest_plan(
    stock_list: DataFrame, stored: DataFrame, as_of: date, first_load_months: int = FIRST_LOAD_MONTHS
) -> DataFrame:
    """The date range to load per symbol of the universe; symbols that are up to date are left out."""
    today = F.lit(as_of)
    first = F.add_months(today, -first_load_months)
    symbols = stock_list.select("tradingsymbol").distinct()
    planned = symbols.join(ingest_watermark(stored), "tradingsymbol", "left")
    return planned.filter(F.col("max_date").isNull() | (F.col("max_date") < today)).select(
        "tradingsymbol",
        F.coalesce(F.date_add("max_date", 1), first).alias("from_date"),
        today.alias("to_date"),
    )


def ingest_new_bars(bars: DataFrame, plan: DataFrame, min_new_bars: int = 1) -> DataFrame:
    """The bars inside each symbol's planned range.

    ``min_new_bars = 2`` skips symbols for which a single new bar arrived. The plan has one row per
    symbol, so the join does not multiply rows, and AQE broadcasts it when it is small or splits hot
    symbols when it is not.
    """
    inside: Column = F.col("date").between(F.col("from_date"), F.col("to_date"))
    fresh = bars.join(plan, "tradingsymbol").filter(inside).select(*bars.columns)
    if min_new_bars <= 1:
        return fresh
    enough = (
        fresh.groupBy("tradingsymbol")
        .agg(F.count(F.lit(1)).alias("_new"))
        .filter(F.col("_new") >= min_new_bars)
    )
    return fresh.join(enough, "tradingsymbol", "left_semi")


def tick_spans(plan: DataFrame) -> tuple[date | None, list[tuple[date, list[str]]]]:
    """From when all symbols' ticks are needed, and from when those of a few older ones, by name.

    At most ``LISTED_SYMBOLS`` symbols with the oldest ranges (halted or new ones) are named, in at most ``SPANS`` groups of
    like age; so they do not open the scan of all others. Collected are one row per distinct start, and the named symbols.
    """
    starts = [tuple(r) for r in plan.groupBy("from_date").agg(F.count(F.lit(1))).orderBy("from_date").collect()]
    if not starts:
        return None, []
    named, cut = 0, 0
    while cut < len(starts) - 1 and named + starts[cut][1] <= LISTED_SYMBOLS:
        named += starts[cut][1]
        cut += 1
    common = starts[cut][0]
    older = plan.filter((F.col("from_date") < F.lit(common)) & F.col("tradingsymbol").isNotNull())
    by_start: dict[date, list[str]] = {}
    for row in older.select("tradingsymbol", "from_date").collect() if cut else []:
        by_start.setdefault(row["from_date"], []).append(row["tradingsymbol"])
    ages = sorted(by_start)
    size = -(-len(ages) // SPANS) or 1
    groups = [ages[i : i + size] for i in range(0, len(ages), size)]
    return common, [(group[0], sorted(s for age in group for s in by_start[age])) for group in groups]


def planned_ticks(ticks: DataFrame, plan: DataFrame, as_of: date) -> DataFrame:
    """The ticks that can make a planned bar, cut by time before anything is aggregated.

    One pass: the scan's filter is a disjunction of literal spans, one for all symbols and a few older ones that name their
    symbols, so a single halted symbol adds only its own rows. Where ticks are laid out by a ``month`` column (the first of
    the month), the spans bound it too and leave other folders unread. What is left is held against each symbol's
    own range. An empty plan needs no ticks. ``plan`` should be a stored table, for it is read three times.
    """
    common, named = tick_spans(plan)
    if common is None:
        return ticks.filter(F.lit(False))
    kind = ticks.schema["ts"].dataType

    def at(day: date) -> Column:
        return F.lit(datetime.combine(day, time())).cast(kind)

    def since(day: date) -> Column:
        bound = F.col("ts") >= at(day)
        return bound & (F.col("month") >= F.lit(day.replace(day=1))) if "month" in ticks.columns else bound

    wanted = since(common)
    for day, symbols in named:
        wanted = wanted | (since(day) & F.col("tradingsymbol").isin(*symbols))
    inside = ticks.filter((F.col("ts") < at(as_of + timedelta(days=1))) & wanted)
    ranges = plan.select(F.col("tradingsymbol").alias("_symbol"), F.col("from_date").cast(kind).alias("_from"))
    own = (F.col("tradingsymbol") == F.col("_symbol")) & (F.col("ts") >= F.col("_from"))
    return inside.join(ranges, own, "left_semi")


def append_new_bars(
    store: TableStore, bars: DataFrame, stock_list: DataFrame, as_of: date, min_new_bars: int = 1
) -> None:
    """Load new bars into ``stock_timeseries``; a second run adds nothing.

    The plan is fixed before the append starts, because it is read from the table appended to.
    """
    plan = ingest_plan(stock_list, store.read("stock_timeseries"), as_of)
    store.append("stock_timeseries", ingest_new_bars(bars, plan, min_new_bars))
