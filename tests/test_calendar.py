"""Intervals of the exchange's session and the bars on them."""

import datetime as dt

import pytest

from barloom.operators.calendar import session_bars, session_calendar, slots_per_day
from barloom.schemas import TICKS

MONDAY = dt.date(2024, 1, 1)


def at(day, clock):
    """An exchange time as the UTC time of a tick."""
    hour, minute, second = (int(part) for part in clock.split(":"))
    return dt.datetime(2024, 1, day, hour, minute, second) - dt.timedelta(minutes=330)


def ticks(spark, *rows):
    return spark.createDataFrame([(s, at(d, c), n, p, 10) for n, (s, d, c, p) in enumerate(rows)], TICKS)


def by_start(bars):
    return [tuple(r) for r in bars.orderBy("tradingsymbol", "start").collect()]


def test_calendar_leaves_out_weekends_and_holidays(spark):
    days = session_calendar(spark, MONDAY, dt.date(2024, 1, 8), 75, holidays=[dt.date(2024, 1, 3)], extra_days=[dt.date(2024, 1, 6)])
    rows = days.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(6 * 5))
    assert [r["date"].day for r in rows[::5]] == [1, 2, 4, 5, 6, 8]
    assert rows[0]["start"] == dt.datetime(2024, 1, 1, 9, 15) and rows[4]["end"] == dt.datetime(2024, 1, 1, 15, 30)


def test_the_last_interval_may_be_short(spark):
    rows = session_calendar(spark, MONDAY, MONDAY, 60).orderBy("slot").collect()
    assert len(rows) == slots_per_day(60) == 7
    assert (rows[-1]["start"].time(), rows[-1]["end"].time()) == (dt.time(15, 15), dt.time(15, 30))
    assert slots_per_day(375) == 1 and slots_per_day(1) == 375


def test_calendar_of_no_days_and_wrong_lengths(spark):
    assert session_calendar(spark, MONDAY, dt.date(2023, 12, 31), 60).count() == 0
    for minutes in (0, 376):
        with pytest.raises(ValueError):
            session_calendar(spark, MONDAY, MONDAY, minutes)


@pytest.mark.parametrize("carry", [False, True])
def test_gaps_over_a_weekend_are_rows(spark, carry):
    days = session_calendar(spark, MONDAY, dt.date(2024, 1, 8), 125)
    rows = ticks(spark, ("A", 5, "13:30:00", 4.0), ("A", 5, "14:00:00", 6.0), ("A", 8, "11:20:00", 5.0), ("B", 8, "09:15:00", 1.0))
    got = by_start(session_bars(rows, days, 125, carry_close=carry))
    empty = (6.0,) * 4 if carry else (None,) * 4
    friday, monday = dt.date(2024, 1, 5), dt.date(2024, 1, 8)
    assert got == [
        ("A", friday, dt.datetime(2024, 1, 5, 13, 25), 4.0, 6.0, 4.0, 6.0, 20, True),
        ("A", monday, dt.datetime(2024, 1, 8, 9, 15), *empty, 0, False),
        ("A", monday, dt.datetime(2024, 1, 8, 11, 20), 5.0, 5.0, 5.0, 5.0, 10, True),
        ("B", monday, dt.datetime(2024, 1, 8, 9, 15), 1.0, 1.0, 1.0, 1.0, 10, True),
    ]


def test_bounds_of_the_session(spark):
    days = session_calendar(spark, MONDAY, dt.date(2024, 1, 2), 60, holidays=[dt.date(2024, 1, 2)])
    rows = ticks(
        spark,
        ("A", 1, "09:14:59", 1.0),
        ("A", 1, "15:30:00", 2.0),
        ("A", 1, "15:30:01", 3.0),
        ("A", 2, "10:00:00", 4.0),
        ("A", 1, "15:20:00", None),
    )
    got = by_start(session_bars(rows, days, 60))
    assert [(r[2].time(), r[6], r[7]) for r in got] == [(dt.time(15, 15), 2.0, 10)]


def test_no_ticks_make_no_bars(spark):
    days = session_calendar(spark, MONDAY, MONDAY, 60)
    none = session_bars(spark.createDataFrame([], TICKS), days, 60)
    assert none.collect() == []
    missing = spark.createDataFrame([("A", None, 1, 1.0, 1)], TICKS)
    assert session_bars(missing, days, 60).collect() == []
