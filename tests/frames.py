"""Hand-made bars shared by the tests."""

from __future__ import annotations

import datetime as dt

from barloom.schemas import STOCK_TIMESERIES

BAR_SCHEMA = (
    "tradingsymbol string, date date, open double, high double, low double, close double, volume bigint"
)
DAY0 = dt.date(2024, 1, 1)


def bar_rows(symbol, closes, start=DAY0, volumes=None, step=1):
    """Bars whose high and low straddle the close."""
    rows = []
    for i, close in enumerate(map(float, closes)):
        volume = volumes[i] if volumes is not None else 100 + (i * 37) % 91
        day = start + dt.timedelta(days=i * step)
        rows.append((symbol, day, close, close + 1.0 + i % 3, close - 1.0, close, volume))
    return rows


def bars_frame(spark, *series):
    return spark.createDataFrame([row for rows in series for row in rows], BAR_SCHEMA)


assert set(STOCK_TIMESERIES.fieldNames()) == {c.split()[0] for c in BAR_SCHEMA.split(", ")}
