"""Daily bars whose days are closed by a watermark."""

import datetime as dt

import pytest

from barloom.operators.ingest import daily_bars
from barloom.schemas import STOCK_TIMESERIES, TICKS
from barloom.streaming.event_time import StreamRun, event_time_bars, publish_closed

NAMES = ["tradingsymbol", "date", "open", "high", "low", "close", "volume"]


def tick(symbol, day, hour, number, price, shares=1):
    return (symbol, day and dt.datetime(2024, 1, day, hour), number, price, shares)


class Stream:
    def __init__(self, spark, folder):
        self.spark, self.number = spark, 0
        self.source, self.sink, self.state = (str(folder / name) for name in ("landed", "days", "state"))

    def land(self, *ticks):
        self.spark.createDataFrame(list(ticks), TICKS).coalesce(1).write.mode("append").parquet(self.source)

    def run(self, **options):
        return event_time_bars(
            self.spark, self.source, TICKS, lambda t: t, self.sink, self.state, delay="1 day", **options
        )

    def bars(self):
        stored = self.spark.read.schema(STOCK_TIMESERIES).parquet(self.sink)
        return sorted(map(tuple, stored.select(*NAMES).collect()))


@pytest.fixture
def stream(spark, tmp_path):
    return Stream(spark, tmp_path)


def days(rows):
    return [(r[0], r[1].day) for r in rows]


def test_days_close_behind_the_watermark_and_late_ticks_are_counted(spark, stream):
    first = [tick("A", 1, 9, 1, 10.0), tick("A", 2, 9, 2, 11.0), tick("B", 2, 10, 3, 5.0), tick("A", 3, 12, 4, 12.0)]
    stream.land(*first)
    seen = stream.run()
    assert days(stream.bars()) == [("A", 1)]  # the newest tick is of the 3rd at noon: the 2nd may still change
    assert seen.late_groups == 0 and seen.open_days == 3
    second = [tick("A", 2, 8, 5, 9.0), tick("B", 1, 9, 6, 1.0), tick("A", 6, 9, 7, 13.0)]
    stream.land(*second)
    seen = stream.run()
    assert seen.late_groups == 1 and seen.open_days == 1  # the tick of B on the 1st; the 6th is open
    assert days(stream.bars()) == [("A", 1), ("A", 2), ("A", 3), ("B", 2)]
    kept = [t for t in first + second if t[2] not in (6, 7)]
    whole = daily_bars(spark.createDataFrame(kept, TICKS)).select(*NAMES)
    assert stream.bars() == sorted(map(tuple, whole.collect()))
    assert stream.run() == StreamRun(None, 0, 0) and len(stream.bars()) == 4


def test_ticks_without_price_or_time_and_repeated_runs(spark, store, stream):
    stream.land(tick("A", 1, 9, 1, None), tick("A", None, 9, 2, 3.0), tick("A", 2, 9, 3, 4.0), tick(None, 2, 9, 4, 1.0))
    stream.run()
    publish_closed(store, stream.sink)
    assert store.read("stock_timeseries").count() == 0
    stream.land(tick("A", 9, 9, 5, 4.0))
    stream.run()
    for _ in range(2):
        publish_closed(store, stream.sink)
    assert {(r["tradingsymbol"], r["date"].day) for r in store.read("stock_timeseries").collect()} == {("A", 2), (None, 2)}


def test_nothing_is_published_before_the_first_run(store, stream):
    publish_closed(store, stream.sink)
    assert store.read("stock_timeseries").count() == 0


def test_a_killed_run_is_continued(spark, stream):
    """The run ends after its batch was taken in and before the sink holds it: the next one writes it once."""
    stream.land(tick("A", 1, 9, 1, 10.0), tick("A", 9, 9, 2, 11.0))

    def failing(ticks):
        from pyspark.sql import functions as F

        broken = F.when(F.col("price") > 0, F.raise_error(F.lit("killed")).cast("double"))
        return ticks.withColumn("price", broken)

    with pytest.raises(Exception, match="killed"):
        event_time_bars(spark, stream.source, TICKS, failing, stream.sink, stream.state, delay="1 day")
    stream.run()
    assert days(stream.bars()) == [("A", 1)]


def test_days_do_not_follow_the_zone_of_the_session(spark, stream):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        stream.land(tick("A", 1, 23, 1, 10.0), tick("A", 2, 1, 2, 11.0), tick("A", 9, 9, 3, 1.0))
        stream.run()
        assert days(stream.bars()) == [("A", 1), ("A", 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_the_state_holds_bars_not_ticks(spark, stream):
    stream.land(*[tick("HOT", 1, 9, n, float(n + 1)) for n in range(500)], tick("A", 1, 9, 1000, 1.0))
    assert stream.run().open_days == 2
