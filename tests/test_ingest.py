"""Daily bars and their incremental load, batch and stream."""

import datetime as dt

import pytest
from frames import DAY0, bar_rows, bars_frame

from barloom.operators import ingest
from barloom.schemas import TICKS
from barloom.streaming.ingest_stream import ingest_stream

AS_OF = dt.date(2024, 1, 31)


def symbols(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "tradingsymbol string")


def stored(store):
    return {(r["tradingsymbol"], r["date"]) for r in store.read("stock_timeseries").collect()}


def test_daily_bars_order_ties_by_id(spark):
    noon = dt.datetime(2024, 1, 1, 12)
    ticks = [
        ("A", noon, 2, 5.0, 1),
        ("A", noon, 1, 7.0, 2),
        ("A", dt.datetime(2024, 1, 1, 23, 59), 0, 6.0, 3),
        ("A", dt.datetime(2024, 1, 2, 0, 0), 4, 9.0, 4),
    ]
    rows = ingest.daily_bars(spark.createDataFrame(ticks, TICKS)).orderBy("date").collect()
    assert tuple(rows[0])[2:] == (7.0, 7.0, 5.0, 6.0, 6)
    assert tuple(rows[1])[2:] == (9.0, 9.0, 9.0, 9.0, 4)


def test_plan(spark):
    have = bars_frame(
        spark,
        bar_rows("OLD", [1.0] * 10),
        bar_rows("TODAY", [1.0] * 31),
        bar_rows("GONE", [1.0] * 3),
    )
    plan = ingest.ingest_plan(symbols(spark, "OLD", "TODAY", "NEW"), have, AS_OF)
    got = {r["tradingsymbol"]: (r["from_date"], r["to_date"]) for r in plan.collect()}
    assert got == {
        "OLD": (dt.date(2024, 1, 11), AS_OF),
        "NEW": (dt.date(2023, 10, 31), AS_OF),
    }


@pytest.mark.parametrize(
    "as_of, first", [(dt.date(2024, 5, 31), dt.date(2024, 2, 29)), (AS_OF, dt.date(2023, 10, 31))]
)
def test_first_load_clamps_to_the_month_end(spark, as_of, first):
    empty = bars_frame(spark, bar_rows("A", [1.0])).filter("false")
    plan = ingest.ingest_plan(symbols(spark, "A"), empty, as_of).first()
    assert plan["from_date"] == first


def test_append_twice_is_append_once(spark, store):
    bars = bars_frame(spark, bar_rows("A", [1.0] * 20), bar_rows("X", [1.0] * 20))
    universe = symbols(spark, "A")
    ingest.append_new_bars(store, bars, universe, dt.date(2024, 1, 15))
    assert len(stored(store)) == 15
    ingest.append_new_bars(store, bars, universe, dt.date(2024, 1, 15))
    assert len(stored(store)) == 15
    ingest.append_new_bars(store, bars, universe, AS_OF)
    assert stored(store) == {("A", DAY0 + dt.timedelta(days=i)) for i in range(20)}
    assert store.read("stock_timeseries").count() == 20


def test_minimum_of_new_bars(spark, store):
    universe = symbols(spark, "A", "B")
    bars = bars_frame(spark, bar_rows("A", [1.0] * 6), bar_rows("B", [1.0] * 7))
    ingest.append_new_bars(store, bars.filter("date <= '2024-01-05'"), universe, AS_OF)
    ingest.append_new_bars(store, bars, universe, AS_OF, min_new_bars=2)
    assert sorted(s for s, _ in stored(store)) == ["A"] * 5 + ["B"] * 7


def day_ticks(*rows):
    """(symbol, day, hour, tick_id, price) as ticks of one share each."""
    return [(s, dt.datetime(2024, 1, d, h), n, float(p), 1) for s, d, h, n, p in rows]


FILES = [
    day_ticks(("A", 4, 9, 1, 10), ("A", 5, 9, 2, 11), ("B", 5, 9, 3, 5)),
    day_ticks(("A", 5, 15, 4, 20), ("A", 3, 9, 5, 7), ("X", 3, 9, 6, 1)),
    day_ticks(("A", 5, 12, 7, 30), ("B", 4, 9, 8, 6), ("A", 4, 8, 9, 2)),
]


def land(spark, source, ticks):
    spark.createDataFrame(ticks, TICKS).coalesce(1).write.mode("append").parquet(source)


def stream(spark, store, source, state, as_of=AS_OF, **options):
    ingest_stream(
        spark, source, TICKS, lambda batch: batch, store, symbols(spark, "A", "B"), as_of, state, **options
    )


def bar_set(store, table="stock_timeseries"):
    names = ["tradingsymbol", "date", "open", "high", "low", "close", "volume"]
    return {tuple(r) for r in store.read(table).select(*names).collect()}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
@pytest.mark.parametrize("files_per_batch", [1, 2, None])
def test_stream_of_split_days_equals_batch(spark, store, tmp_path, order, files_per_batch):
    source = str(tmp_path / "landed")
    for n in order:
        land(spark, source, FILES[n])
    stream(spark, store, source, str(tmp_path / "state"), files_per_batch=files_per_batch)
    ticks = spark.createDataFrame([t for rows in FILES for t in rows if t[0] != "X"], TICKS)
    names = ["tradingsymbol", "date", "open", "high", "low", "close", "volume"]
    whole = {tuple(r) for r in ingest.daily_bars(ticks).select(*names).collect()}
    assert bar_set(store) == whole and len(whole) == 5
    assert bar_set(store, "late_bars") == set()


def test_open_days_wait_and_passed_days_go_to_late_bars(spark, store, tmp_path):
    source, state = str(tmp_path / "landed"), str(tmp_path / "state")
    land(spark, source, FILES[0])
    stream(spark, store, source, state, dt.date(2024, 1, 5), open_days=1)
    assert {(s, d.day) for s, d in stored(store)} == {("A", 4)}
    land(spark, source, FILES[1])
    stream(spark, store, source, state, dt.date(2024, 1, 6), open_days=1)
    assert ("A", dt.date(2024, 1, 5), 11.0, 20.0, 11.0, 20.0, 2) in bar_set(store)
    assert {(b[0], b[1].day) for b in bar_set(store, "late_bars")} == {("A", 3)}
    before = bar_set(store)
    land(spark, source, FILES[2])
    stream(spark, store, source, state, dt.date(2024, 1, 7), open_days=0)
    assert bar_set(store) == before
    assert {(b[0], b[1].day) for b in bar_set(store, "late_bars")} == {("A", 3), ("A", 4), ("A", 5), ("B", 4)}


class Killed(Exception):
    """Stands for the end of a driver."""


def stops_at(monkeypatch, number):
    """Every write of a table or of a run's folder counts; the one of this number does not come to pass."""
    from pyspark.sql import DataFrameWriter

    state = {"left": number}

    def counted(write):
        def run(*args, **given):
            if state["left"] == 0:
                raise Killed
            state["left"] -= 1
            return write(*args, **given)

        return run

    monkeypatch.setattr(DataFrameWriter, "parquet", counted(DataFrameWriter.parquet))
    monkeypatch.setattr(DataFrameWriter, "insertInto", counted(DataFrameWriter.insertInto))
    return state


def test_killed_runs_lose_and_repeat_nothing(spark, store, tmp_path):
    """Run after run is killed before its first, second, ... write and then repeated: every day is published, every late
    bar recorded once."""
    source, state = str(tmp_path / "landed"), str(tmp_path / "state")

    def ticks(day):
        return day_ticks(("A", day, 9, 2 * day, float(day)), ("A", day - 2, 9, 2 * day + 1, 0.5))

    land(spark, source, ticks(3))
    stream(spark, store, source, state, dt.date(2024, 1, 4))
    day, killed = 4, True
    while killed:
        land(spark, source, ticks(day))
        with pytest.MonkeyPatch.context() as patch:
            stops_at(patch, day - 4)
            try:
                stream(spark, store, source, state, dt.date(2024, 1, day + 1))
                killed = False
            except Exception:  # the stream wraps what its batches raise
                stream_again = True
        stream(spark, store, source, state, dt.date(2024, 1, day + 1))
        day += 1
    assert stream_again and day - 4 >= 9
    bars = sorted((r["date"].day, r["close"]) for r in store.read("stock_timeseries").collect())
    assert bars == [(1, 0.5)] + [(d, float(d)) for d in range(3, day)]
    late = sorted((r["date"].day, r["close"]) for r in store.read("late_bars").collect())
    assert late == [(d, 0.5) for d in range(2, day - 2)]


def test_a_run_reads_new_and_open_parts_only(spark, store, tmp_path):
    from barloom.sources import files
    from barloom.streaming.ingest_stream import StreamLog

    source, state = str(tmp_path / "landed"), str(tmp_path / "state")
    log = StreamLog(store, state)
    for n, day in enumerate((5, 6, 7, 8)):
        if n < 3:
            land(spark, source, FILES[n])
        stream(spark, store, source, state, dt.date(2024, 1, day))
        assert log.batches(-1) == [] and [name for name, _ in files.children(spark, log.runs)] == [f"run={n}"]
    open_days = {(r["tradingsymbol"], r["date"].day) for r in log.partials([log.folder(3, "open")]).collect()}
    assert all(symbol == "X" for symbol, _ in open_days)  # not in the list of stocks: waits
    assert log.last() == (3, 2, True)


def test_open_days_are_published_without_new_files(spark, store, tmp_path):
    source, state = str(tmp_path / "landed"), str(tmp_path / "state")
    land(spark, source, FILES[0])
    stream(spark, store, source, state, dt.date(2024, 1, 5))
    assert {d.day for _, d in stored(store)} == {4}
    stream(spark, store, source, state, dt.date(2024, 1, 6))
    assert {d.day for _, d in stored(store)} == {4, 5}


def test_restarted_stream_from_scratch_adds_nothing(spark, store, tmp_path):
    source = str(tmp_path / "landed")
    land(spark, source, FILES[0])
    for run in ("one", "two"):
        stream(spark, store, source, str(tmp_path / run))
    assert store.read("stock_timeseries").count() == 3


def scans(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    return [line for line in text.splitlines() if "FileScan" in line and "ts#" in line]


def same_bars(ticks, cut, plan):
    new = ingest.ingest_new_bars(ingest.daily_bars(cut), plan)
    whole = ingest.ingest_new_bars(ingest.daily_bars(ticks), plan)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, whole.collect()))
    return new


def test_ticks_are_cut_by_time_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "ticks")
    land(spark, path, [t for rows in FILES for t in rows])
    ticks = spark.read.schema(TICKS).parquet(path)
    have = bars_frame(spark, bar_rows("A", [1.0] * 4))
    plan = ingest.ingest_plan(symbols(spark, "A", "B"), have, AS_OF)
    cut = ingest.planned_ticks(ticks, plan, AS_OF)
    (scan,) = scans(cut)
    assert "Or(GreaterThanOrEqual(ts,2024-01-05T00:00),And(GreaterThanOrEqual(ts,2023-10-31T00:00),EqualTo(tradingsymbol,B)" in scan
    assert "LessThan(ts,2024-02-01T00:00)" in scan
    same_bars(ticks, cut, plan)


def test_one_halted_symbol_does_not_open_the_scan_of_the_others(spark, tmp_path):
    from pyspark.sql import functions as F

    path, plans = str(tmp_path / "ticks"), str(tmp_path / "plan")
    rows = [(s, dt.datetime(2024, m, 10, 9), 10 * m + i, float(m), 1) for i, s in enumerate("ABC") for m in range(1, 7)]
    ticks = spark.createDataFrame(rows, TICKS).withColumn("month", F.trunc("ts", "month"))
    ticks.write.partitionBy("month").parquet(path)
    as_of = dt.date(2024, 6, 30)
    have = bars_frame(spark, bar_rows("A", [1.0], dt.date(2024, 3, 31)), bar_rows("B", [1.0], as_of - dt.timedelta(days=40)), bar_rows("C", [1.0], as_of - dt.timedelta(days=40)))
    ingest.ingest_plan(symbols(spark, "A", "B", "C"), have, as_of).write.parquet(plans)
    plan = spark.read.parquet(plans)
    assert ingest.tick_spans(plan) == (dt.date(2024, 5, 22), [(dt.date(2024, 4, 1), ["A"])])
    stored_ticks = spark.read.parquet(path)
    cut = ingest.planned_ticks(stored_ticks, plan, as_of)
    (scan,) = scans(cut)
    assert "month#" in scan[scan.index("PartitionFilters") : scan.index("PushedFilters")]
    for month in (1, 2, 3):  # folders no span reaches need not even be readable
        for file in (tmp_path / "ticks" / f"month=2024-0{month}-01").glob("*.parquet"):
            file.write_bytes(b"unreadable")
            (file.parent / f".{file.name}.crc").unlink()
    got = {(r["tradingsymbol"], r["ts"].month) for r in cut.collect()}
    assert got == {("A", 4), ("A", 5), ("A", 6), ("B", 6), ("C", 6)}


def test_spans_are_few_and_lose_no_symbol(spark, monkeypatch):
    monkeypatch.setattr(ingest, "LISTED_SYMBOLS", 30)
    have = bars_frame(spark, *[bar_rows(f"S{n:02}", [1.0] * (1 + n % 20)) for n in range(60)])
    plan = ingest.ingest_plan(symbols(spark, *[f"S{n:02}" for n in range(60)], "NEW"), have, AS_OF)
    common, named = ingest.tick_spans(plan)
    assert len(named) <= ingest.SPANS and sum(len(s) for _, s in named) <= 30
    starts = {r["tradingsymbol"]: r["from_date"] for r in plan.collect()}
    reached = {s: day for day, group in named for s in group}
    assert all(reached.get(s, common) <= start for s, start in starts.items())
    ticks = spark.createDataFrame([(f"S{n:02}", dt.datetime(2024, 1, d, 9), 100 * n + d, 1.0, 1) for n in range(60) for d in range(1, 31)], TICKS)
    assert same_bars(ticks, ingest.planned_ticks(ticks, plan, AS_OF), plan).count() == sum(30 - (1 + n % 20) for n in range(60))


def test_an_empty_plan_needs_no_ticks(spark):
    ticks = spark.createDataFrame(FILES[0], TICKS)
    plan = ingest.ingest_plan(symbols(spark, "A").filter("false"), bars_frame(spark, bar_rows("A", [1.0])), AS_OF)
    assert ingest.planned_ticks(ticks, plan, AS_OF).collect() == []


def test_interval_bars(spark):
    ticks = spark.createDataFrame(FILES[0] + FILES[2], TICKS)
    starts = {
        name: {r["start"] for r in ingest.interval_bars(ticks, name).filter("tradingsymbol = 'A'").collect()}
        for name in ingest.INTERVALS
    }
    assert starts["60minute"] == starts["15minute"] == starts["minute"] == {
        dt.datetime(2024, 1, d, h) for d, h in ((4, 9), (4, 8), (5, 9), (5, 12))
    }
    assert starts["day"] == {dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 5)}
    assert starts["week"] == {dt.datetime(2024, 1, 1)}


def test_ticks_without_a_price_make_no_bar(spark):
    ticks = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1, None, 1), *FILES[0]], TICKS)
    assert {(r["tradingsymbol"], r["date"].day) for r in ingest.daily_bars(ticks).collect()} == {("A", 4), ("A", 5), ("B", 5)}
