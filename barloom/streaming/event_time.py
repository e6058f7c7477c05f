"""Daily bars by event time: days stay in the stream's state until the watermark has passed them.

``ingest_stream`` closes days by the date of the run and keeps open ones in folders of its own. Here Spark's state store
does that: a day's bar is emitted once, when no tick older than ``delay`` behind the newest one can change it any more. Ticks
that come later than that are left out by Spark, and their number is reported.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.ingest import bar_values, tick_key
from barloom.schemas import STOCK_TIMESERIES
from barloom.sources import files
from barloom.sources.store import TableStore

DAY_SECONDS = 86_400


@dataclass(frozen=True)
class StreamRun:
    """What one run saw: the watermark it ended with, groups of late ticks it left out, days still in the state."""

    watermark: str | None
    late_groups: int
    open_days: int


def closed_days(ticks: DataFrame, delay: str) -> DataFrame:
    """Streaming bars per symbol and day, emitted when the watermark passes the end of the day.

    The state holds one row per symbol and open day, not the ticks; ticks are combined before they are shuffled, so a
    symbol with any share of them is no hot key. Ticks without a price make no bar. A tick without a time has no day
    and is left out too.
    """
    timed = ticks.filter(F.col("price").isNotNull() & F.col("ts").isNotNull()).withColumn("_event", _instant(F.col("ts")))
    day = F.window("_event", "1 day")
    bars = timed.withWatermark("_event", delay).groupBy("tradingsymbol", day).agg(*bar_values(tick_key(None)))
    start = F.floor(F.unix_seconds(F.col("window")["start"]) / DAY_SECONDS)
    return bars.select(
        "tradingsymbol", F.date_from_unix_date(start.cast("int")).alias("date"), "open", "high", "low", "close", "volume"
    )


def _instant(ts: Column) -> Column:
    """A time without zone as an instant, which watermarks need, read as UTC whatever the session's zone is."""
    days = F.unix_date(F.to_date(ts)).cast("long")
    return F.timestamp_seconds(days * DAY_SECONDS + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)))


def event_time_bars(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    to_ticks: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    delay: str = "2 days",
    files_per_batch: int | None = None,
) -> StreamRun:
    """Take in the tick files under ``source`` that are new and write the days that this closes to ``sink``, then stop.

    State and offsets live under ``checkpoint``, which must be shared by the cluster, and the sink notes each batch it
    holds, so a run that is killed anywhere is continued by the next one without a lost or a repeated bar. Runs without new
    files are allowed and write nothing.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        closed_days(to_ticks(reader.parquet(source)), delay)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    late = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
    watermark = progress[-1]["eventTime"].get("watermark") if progress else None
    return StreamRun(watermark, late, progress[-1]["stateOperators"][0]["numRowsTotal"] if progress else 0)


def publish_closed(store: TableStore, sink: str) -> None:
    """Append the closed days that ``stock_timeseries`` does not hold yet; a second call adds nothing.

    A run that ended before its first batch leaves no sink; then there is nothing to publish.
    """
    if files.children(store.spark, sink):
        bars = store.spark.read.schema(STOCK_TIMESERIES).parquet(sink)
        store.append_missing("stock_timeseries", bars, ["tradingsymbol", "date"])
