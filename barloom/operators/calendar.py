"""The exchange's calendar of bar intervals, and bars on it with the missing ones made explicit."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.ingest import bar_values, tick_key
from barloom.operators.market import SESSION_CLOSE, SESSION_OPEN, market_session

SYMBOL = "tradingsymbol"


def _minutes(clock: str) -> int:
    hours, minutes = clock.split(":")
    return 60 * int(hours) + int(minutes)


SESSION_MINUTES = _minutes(SESSION_CLOSE) - _minutes(SESSION_OPEN)


def slots_per_day(minutes: int) -> int:
    """Intervals of a session; the last one is shorter where the length does not divide the session."""
    return -(-SESSION_MINUTES // minutes)


def session_calendar(
    spark: SparkSession,
    first: date,
    last: date,
    minutes: int,
    holidays: Sequence[date] = (),
    extra_days: Sequence[date] = (),
) -> DataFrame:
    """(slot, date, start, end) of every interval from ``first`` to ``last``, both inclusive, in exchange time.

    Trading days are Monday to Friday without ``holidays`` and with ``extra_days`` (special sessions). Slots are numbered from
    0 without gaps over nights and weekends, so neighbouring intervals have neighbouring numbers. Days are numbered in one
    task: a calendar has a row per day there, some 40,000 for a century. ``last`` before ``first`` gives no rows.
    """
    if not 0 < minutes <= SESSION_MINUTES:
        raise ValueError(f"an interval has 1 to {SESSION_MINUTES} minutes")
    length = max((last - first).days + 1, 0)
    day = F.date_add(F.lit(first), F.col("id").cast("int"))
    trading = (F.weekday("date") < 5) & ~_one_of(F.col("date"), holidays) | _one_of(F.col("date"), extra_days)
    days = spark.range(length).select(day.alias("date")).filter(trading)
    numbered = days.withColumn("_day", F.row_number().over(Window.orderBy("date")) - 1)
    per_day = slots_per_day(minutes)
    slots = numbered.select("date", "_day", F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))).alias("_slot"))
    begin = _minutes(SESSION_OPEN) + F.col("_slot") * minutes
    return slots.select(
        (F.col("_day").cast("long") * per_day + F.col("_slot")).alias("slot"),
        "date",
        _clock(begin).alias("start"),
        _clock(F.least(begin + minutes, F.lit(_minutes(SESSION_CLOSE)))).alias("end"),
    )


def _one_of(day: Column, days: Sequence[date]) -> Column:
    return day.isin(*days) if days else F.lit(False)


def _clock(minute: Column) -> Column:
    zero = F.lit(0)
    return F.col("date").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, minute, F.lit(0.0))


def session_bars(
    ticks: DataFrame, calendar: DataFrame, minutes: int, source_zone: str = "UTC", carry_close: bool = False
) -> DataFrame:
    """Bars per symbol and interval of the session, with a row for each interval without a trade.

    Intervals count from the opening of the session, not from the full hour; a trade at the closing second belongs to the last
    one. Ticks outside the session or the calendar and those without price or time make no bar. ``calendar`` comes from
    :func:`session_calendar` with the same ``minutes``.

    Between a symbol's first and last traded interval every one of the calendar has a row; those without a trade have
    ``traded`` false, volume 0 and no prices, or four times the previous close with ``carry_close``. Columns:
    ``tradingsymbol, date, start, open, high, low, close, volume, traded``.

    Ticks are combined before their shuffle. The missing intervals come from the distance to a symbol's next traded slot,
    so the work follows the rows that come out, and a symbol's partition holds at most one row per slot of the calendar.
    """
    local = market_session(ticks.filter(F.col("price").isNotNull()), source_zone=source_zone)
    opened = F.to_date("local_ts").cast("timestamp_ntz") + F.expr(f"INTERVAL '{SESSION_OPEN}' HOUR TO MINUTE")
    passed = 60 * F.hour("local_ts") + F.minute("local_ts") - _minutes(SESSION_OPEN)
    slot = F.least(F.floor(passed / minutes), F.lit(slots_per_day(minutes) - 1))
    zero = F.lit(0)
    start = opened + F.make_dt_interval(zero, zero, (slot * minutes).cast("int"), F.lit(0.0))
    traded = local.groupBy(SYMBOL, start.alias("start")).agg(*bar_values(tick_key(None)))
    placed = traded.join(calendar.select("start", "slot"), "start").drop("start")
    following = F.lead("slot").over(Window.partitionBy(SYMBOL).orderBy("slot"))
    spans = placed.withColumn("_until", F.coalesce(following - 1, F.col("slot")))
    rows = spans.select("*", F.explode(F.sequence("slot", "_until")).alias("_at"))
    own = F.col("_at") == F.col("slot")
    empty = F.col("close") if carry_close else F.lit(None)
    prices = [F.when(own, F.col(name)).otherwise(empty).alias(name) for name in ("open", "high", "low", "close")]
    volume = F.when(own, F.col("volume")).otherwise(F.lit(0))
    filled = rows.select(SYMBOL, F.col("_at").alias("slot"), *prices, volume.alias("volume"), own.alias("traded"))
    return filled.join(calendar.select("slot", "date", "start"), "slot").select(
        SYMBOL, "date", "start", "open", "high", "low", "close", "volume", "traded"
    )
