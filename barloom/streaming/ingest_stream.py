"""Incremental load as a stream: landed tick files, one pass over what is new, however they split days.

A run has three steps, and a run that dies in any of them is finished by the next one:

1. The stream reduces new files to partial bars, one folder per micro-batch. A replayed batch overwrites its folder.
2. The run is *prepared*: partial bars of the new batches and the days that were still open are merged and split into bars to
   publish, late bars and days that stay open, all written to a folder of the run. Then the log notes the run and its
   newest batch. Until that note nothing has changed, and the next run prepares the same batches again.
3. The run is *applied*: its bars and late bars are appended unless they are there already, the log notes that too, and the
   folders that are no longer needed go.

So a run reads new partial bars and open days only, however many runs there have been.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.ingest import (
    FIRST_LOAD_MONTHS,
    ingest_new_bars,
    ingest_plan,
    ingest_watermark,
    merged_bars,
    merged_partials,
    partial_bars,
)
from barloom.schemas import STOCK_TIMESERIES
from barloom.session import cut_lineage, scratch_scope
from barloom.sources import files
from barloom.sources.store import TableStore

_KEY = "struct<ts:timestamp_ntz,tick_id:bigint>"
_BAR = "tradingsymbol string, date date, open double, high double, low double, close double, volume bigint"
PARTIAL = f"{_BAR}, first_key {_KEY}, last_key {_KEY}"


class StreamLog:
    """The runs of one stream and the folders they hand over in."""

    def __init__(self, store: TableStore, checkpoint: str):
        self.store, self.spark = store, store.spark
        self.stream = checkpoint.rstrip("/")
        self.parts, self.runs = f"{self.stream}-parts", f"{self.stream}-runs"

    def last(self) -> tuple[int, int, bool]:
        """Number and newest batch of the last prepared run, and whether it has been applied."""
        rows = self.store.read("stream_log").filter(F.col("stream") == self.stream)
        newest = rows.groupBy("run", "last_batch").agg(F.max((F.col("state") == "applied").cast("int")).alias("applied"))
        row = newest.orderBy(F.desc("run")).first()
        return (row["run"], row["last_batch"], bool(row["applied"])) if row else (-1, -1, True)

    def note(self, run: int, last_batch: int, state: str) -> None:
        entry = [(self.stream, run, last_batch, state)]
        self.store.append("stream_log", self.spark.createDataFrame(entry, "stream string, run long, last_batch long, state string"))

    def batches(self, after: int) -> list[int]:
        found = [name for name, _ in files.children(self.spark, self.parts) if name.startswith("batch=")]
        return sorted(n for n in (int(name[len("batch=") :]) for name in found) if n > after)

    def part(self, batch: int) -> str:
        return f"{self.parts}/batch={batch}"

    def folder(self, run: int, what: str) -> str:
        return f"{self.runs}/run={run}/{what}"

    def partials(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], PARTIAL)
        return self.spark.read.schema(PARTIAL).parquet(*paths)

    def clear(self, run: int, last_batch: int) -> None:
        """Remove what only runs up to ``run`` needed; the days it left open are still to be read."""
        for name, _ in files.children(self.spark, self.runs):
            if name != f"run={run}":
                files.remove(self.spark, f"{self.runs}/{name}")
        for name, _ in files.children(self.spark, self.parts):
            if name.startswith("batch=") and int(name[len("batch=") :]) <= last_batch:
                files.remove(self.spark, f"{self.parts}/{name}")


def ingest_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    to_ticks: Callable[[DataFrame], DataFrame],
    store: TableStore,
    stock_list: DataFrame,
    as_of: date,
    checkpoint: str,
    file_glob: str | None = None,
    files_per_batch: int | None = None,
    min_new_bars: int = 1,
    open_days: int = 1,
) -> None:
    """Take in the tick files under ``source`` that are new, append the bars of closed days, then stop.

    A day is closed when it is at least ``open_days`` before ``as_of``: with the default 1 today stays open, with 0 it is
    published with what has come so far. A day may be split over files, batches and runs, in any order. Ticks for a day
    that its symbol has already passed change no bar; their bars go to ``late_bars`` under the run that found them.
    Bars without a place in the plan, such as those of symbols that are not in ``stock_list``, wait for as long as a
    first load reaches back.
    """
    log = StreamLog(store, checkpoint)
    _apply(log)
    _take_in(spark, source, schema, to_ticks, log, checkpoint, file_glob, files_per_batch)
    with scratch_scope(spark):
        _prepare(log, stock_list, as_of, min_new_bars, open_days)
    _apply(log)


def _take_in(spark, source, schema, to_ticks, log: StreamLog, checkpoint, file_glob, files_per_batch) -> None:
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def reduce_batch(batch: DataFrame, batch_id: int) -> None:
        partial_bars(to_ticks(batch)).write.mode("overwrite").parquet(log.part(batch_id))

    query = (
        reader.parquet(source)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(reduce_batch)
        .start()
    )
    query.awaitTermination()


def _prepare(log: StreamLog, stock_list: DataFrame, as_of: date, min_new_bars: int, open_days: int) -> None:
    """Work out what the new batches and the open days change, and note it in the log."""
    store = log.store
    before, seen, _ = log.last()
    batches = log.batches(seen)
    run, last_batch = before + 1, batches[-1] if batches else seen
    waiting = [log.folder(before, "open")] if before >= 0 else []
    pieces = merged_partials(log.partials([*waiting, *map(log.part, batches)]))
    stored = cut_lineage(ingest_watermark(store.read("stock_timeseries")), "watermarks")
    pieces = cut_lineage(pieces.join(stored, "tradingsymbol", "left"), "pieces")
    passed = F.coalesce(F.col("date") <= F.col("max_date"), F.lit(False))
    late, rest = pieces.filter(passed).drop("max_date"), pieces.filter(~passed).drop("max_date")
    late = merged_bars(late).withColumns({"stream": F.lit(log.stream), "run": F.lit(run), "Date_Update": F.lit(as_of)})
    late.write.mode("overwrite").parquet(log.folder(run, "late"))
    closed = F.col("date") <= F.date_sub(F.lit(as_of), open_days)
    plan = ingest_plan(stock_list, stored.withColumnRenamed("max_date", "date"), as_of)
    bars = ingest_new_bars(rest.filter(closed).drop("first_key", "last_key"), plan, min_new_bars)
    bars.write.mode("overwrite").parquet(log.folder(run, "bars"))
    published = log.spark.read.schema(bars.schema).parquet(log.folder(run, "bars")).select("tradingsymbol", "date")
    left = rest.filter(F.col("date") >= F.add_months(F.lit(as_of), -FIRST_LOAD_MONTHS))
    left = left.join(published, ["tradingsymbol", "date"], "left_anti")
    left.write.mode("overwrite").parquet(log.folder(run, "open"))
    log.note(run, last_batch, "prepared")


def _apply(log: StreamLog) -> None:
    """Append what the last prepared run found, once, however often this is begun."""
    run, last_batch, applied = log.last()
    if run < 0:
        return
    if not applied:
        store, spark = log.store, log.spark
        bars = spark.read.schema(STOCK_TIMESERIES).parquet(log.folder(run, "bars"))
        store.append_missing("stock_timeseries", bars, ["tradingsymbol", "date"])
        done = store.read("late_bars").filter((F.col("stream") == log.stream) & (F.col("run") == run))
        if done.isEmpty():
            late = spark.read.parquet(log.folder(run, "late"))
            store.append("late_bars", late)
        log.note(run, last_batch, "applied")
    log.clear(run, last_batch)
