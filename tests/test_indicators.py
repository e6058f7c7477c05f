"""Indicators against a plain fold over the bars, whole and in chunks."""

import math

import numpy as np
import pandas as pd
import pytest
from frames import bar_rows, bars_frame
from pyspark.sql import functions as F

from barloom.functions import series
from barloom.functions.columns import round_half_up
from barloom.operators import indicators as ind
from barloom.schemas import INDICATOR_COLUMNS

WARM_UP = [1, 2, 13, 14, 15, 20, 21, 22, 23, 49, 50, 51]


def _mean(values):
    return sum(values) / len(values)


def _deviation(values):
    middle = _mean(values)
    return math.sqrt(sum((v - middle) ** 2 for v in values) / (len(values) - 1))


def _full(values, size):
    """The last ``size`` values, or None while there are fewer or one of them is missing."""
    window = values[-size:]
    return window if len(window) == size and None not in window else None


def _ratio(now, then):
    return None if not then else now / then - 1


class Series:
    """One bar after the other: explicit windows, and averages carried from bar to bar."""

    def __init__(self):
        self.closes, self.gains, self.losses, self.spans, self.volumes, self.changes = ([] for _ in range(6))
        self.fast = self.slow = self.signal = None
        self.flow = 0.0

    @staticmethod
    def _carried(average, value, span):
        return value if average is None else average + (value - average) * 2 / (span + 1)

    def add(self, high, low, close, volume):
        last = self.closes[-1] if self.closes else None
        self.closes.append(close)
        self.volumes.append(volume)
        self.gains.append(None if last is None else max(close - last, 0.0))
        self.losses.append(None if last is None else max(last - close, 0.0))
        reach = [high] if last is None else [high, last]
        floor = [low] if last is None else [low, last]
        self.spans.append(max(reach) - min(floor))
        self.changes.append(None if last is None else _ratio(close, last))
        if last is not None and close != last:
            self.flow += volume if close > last else -volume
        self.fast, self.slow = self._carried(self.fast, close, 12), self._carried(self.slow, close, 26)
        self.signal = self._carried(self.signal, self.fast - self.slow, 9)
        gain, loss = _full(self.gains, 14), _full(self.losses, 14)
        strength = None
        if gain and _mean(gain) + _mean(loss) > 0:
            strength = 100 * _mean(gain) / (_mean(gain) + _mean(loss))

        def over(values, size, summary):
            window = _full(values, size)
            return None if window is None else summary(window)

        def since(days):
            return _ratio(close, self.closes[-1 - days]) if len(self.closes) > days else None

        return {
            "MA20": over(self.closes, 20, _mean),
            "MA50": over(self.closes, 50, _mean),
            "RSI14": strength,
            "ATR14": over(self.spans, 14, _mean),
            "MACD": self.fast - self.slow,
            "MACD_signal": self.signal,
            "OBV": self.flow,
            "avg_daily_volume": over(self.volumes, 20, _mean),
            "volatility_1m": over(self.changes, 22, _deviation),
            "price_change_1w": since(5),
            "price_change_1m": since(22),
        }


def expected(rows):
    """The indicators of one series, folded bar by bar."""
    series, found = Series(), []
    for symbol, day, _open, high, low, close, volume in rows:
        found.append({"tradingsymbol": symbol, "date": day} | series.add(high, low, close, volume))
    return pd.DataFrame(found)


def walk(seed, n):
    return list(np.round(100 + np.random.default_rng(seed).normal(0, 2, n).cumsum(), 2))


def assert_same(spark_df, frames):
    got = spark_df.select("tradingsymbol", "date", *INDICATOR_COLUMNS).toPandas()
    got = got.sort_values(["tradingsymbol", "date"]).reset_index(drop=True)
    want = pd.concat(frames).sort_values(["tradingsymbol", "date"]).reset_index(drop=True)
    assert len(got) == len(want)
    for name in INDICATOR_COLUMNS:
        np.testing.assert_allclose(
            got[name].astype(float), want[name].astype(float), rtol=1e-9, atol=1e-9, err_msg=name
        )


@pytest.mark.parametrize("chunk_rows", [1024, 50])
def test_warm_up(spark, chunk_rows):
    rows = [bar_rows(f"L{n:02d}", walk(n, n)) for n in WARM_UP]
    bars = bars_frame(spark, *rows)
    assert_same(ind.indicators(bars, chunk_rows=chunk_rows), [expected(r) for r in rows])


@pytest.mark.parametrize("chunk_rows", [64, 200, 1024])
def test_long_series_in_chunks(spark, chunk_rows):
    """A hot symbol with most of the rows, next to short ones; weekly bars span many years."""
    rows = [
        bar_rows("HOT", walk(1, 3000), step=2),
        bar_rows("A", walk(2, 70)),
        bar_rows("B", walk(3, chunk_rows)),
        bar_rows("C", walk(4, chunk_rows + 1)),
    ]
    bars = bars_frame(spark, *rows)
    assert_same(ind.indicators(bars, chunk_rows=chunk_rows), [expected(r) for r in rows])


def test_ten_thousand_bars_stay_finite(spark):
    rows = bar_rows("X", walk(5, 10_000))
    got = ind.macd(bars_frame(spark, rows))
    want = expected(rows)
    pdf = got.select("date", "MACD", "MACD_signal").toPandas().sort_values("date")
    np.testing.assert_allclose(pdf["MACD"], want["MACD"], rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(pdf["MACD_signal"], want["MACD_signal"], rtol=1e-9, atol=1e-9)


def test_no_task_holds_more_than_a_chunk(spark):
    bars = bars_frame(spark, bar_rows("HOT", walk(1, 2000)), bar_rows("A", walk(2, 30)))
    frame = series.in_chunks(series.number_rows(bars), 49, 100)
    sizes = frame.df.groupBy(*frame.keys).count()
    assert sizes.agg(F.max("count")).first()[0] == 149
    assert frame.rows().count() == 2030


def test_positions_across_years(spark):
    bars = bars_frame(spark, bar_rows("A", walk(1, 900)), bar_rows("B", walk(2, 10)))
    numbered = series.number_rows(bars)
    by_symbol = numbered.orderBy("tradingsymbol", "date").collect()
    assert [r["pos"] for r in by_symbol] == [*range(900), *range(10)]
    assert {r["_n_rows"] for r in by_symbol if r["tradingsymbol"] == "A"} == {900}


def test_rising_and_flat(spark):
    bars = bars_frame(
        spark,
        bar_rows("FLAT", [10.0] * 30),
        bar_rows("RISE", [10.0 + i for i in range(30)]),
        bar_rows("FALL", [50.0 - i for i in range(30)]),
    )
    last = {r["tradingsymbol"]: r for r in ind.latest_bar(bars).collect()}
    assert last["FLAT"]["RSI14"] is None and last["FLAT"]["OBV"] == 0
    assert last["RISE"]["RSI14"] == 100 and last["FALL"]["RSI14"] == 0


def test_zero_close_gives_null_not_an_error(spark):
    closes = walk(9, 40)
    closes[20] = 0.0
    rows = {r["pos"]: r for r in ind.indicators(bars_frame(spark, bar_rows("Z", closes))).collect()}
    assert rows[25]["price_change_1w"] is None and rows[20]["price_change_1w"] == -1
    assert rows[39]["volatility_1m"] is None


@pytest.mark.parametrize("chunk_rows", [1024, 60])
def test_latest_bar(spark, chunk_rows):
    rows = [bar_rows(f"L{n}", walk(n, n)) for n in (1, 2, 60, 61, 120, 121, 180)]
    bars = bars_frame(spark, *rows)
    got = {r["tradingsymbol"]: r for r in ind.latest_bar(bars, chunk_rows=chunk_rows).collect()}
    assert set(got) == {"L2", "L60", "L61", "L120", "L121", "L180"}
    for series_rows in rows[1:]:
        want, row = expected(series_rows), got[series_rows[0][0]]
        assert row["date"] == want["date"].iloc[-1]
        assert row["OBV"] == pytest.approx(want["OBV"].iloc[-1])
        assert row["previous_OBV"] == pytest.approx(want["OBV"].iloc[-2])
        assert row["MACD_signal"] == pytest.approx(want["MACD_signal"].iloc[-1])


def test_row_order_and_other_symbols_do_not_matter(spark):
    a, b = bar_rows("A", walk(1, 80)), bar_rows("B", walk(2, 80))
    alone = ind.indicators(bars_frame(spark, a)).orderBy("date").collect()
    mixed = ind.indicators(bars_frame(spark, list(reversed(a)), b))
    mixed = mixed.filter("tradingsymbol = 'A'").orderBy("date").collect()
    assert alone == mixed


def test_empty_bars(spark):
    empty = bars_frame(spark, bar_rows("A", [1.0])).filter("false")
    result = ind.indicators(empty)
    assert result.count() == 0
    assert result.columns == [*empty.columns, "pos", *INDICATOR_COLUMNS]


def test_chunk_longer_than_the_average_can_hold(spark):
    bars = bars_frame(spark, bar_rows("A", [1.0, 2.0]))
    with pytest.raises(ValueError):
        ind.macd(bars, chunk_rows=4000)


def test_parts_equal_whole_look_backs(spark):
    """Indicators put together from parts against one frame per look-back, over values missing here and there."""
    rng = np.random.default_rng(11)
    rows = bar_rows("A", np.round(np.maximum(50 + rng.normal(0, 5, 120).cumsum(), 0.5), 2))
    rows += bar_rows("Z", [0.0 if i in (30, 31) else 5.0 + i % 3 for i in range(70)])
    bars = bars_frame(spark, rows).withColumn("volume", F.when(F.col("close") != 7.0, F.col("volume")))
    got = ind.indicators(bars)
    frame = series.series_frame(bars, 49, 120)
    steps = [{"_b": frame.previous("close")}, {"_r": F.try_divide(F.col("close"), F.col("_b")) - 1}]
    whole = {
        "MA20": frame.rolling(F.avg, "close", 20, first=0),
        "MA50": frame.rolling(F.avg, "close", 50, first=0),
        "avg_daily_volume": frame.rolling(F.avg, "volume", 20),
        "volatility_1m": frame.rolling(F.stddev_samp, "_r", 22),
    }
    names = ["tradingsymbol", "date", *whole]
    want = frame.with_steps([*steps, whole]).rows().select(names).orderBy(names[:2]).collect()
    found = got.select(names).orderBy(names[:2]).collect()
    assert [[v is None for v in r] for r in found] == [[v is None for v in r] for r in want]
    for a, b in zip(found, want, strict=True):
        assert [x for x in a[2:] if x is not None] == pytest.approx([x for x in b[2:] if x is not None], rel=1e-12)


def test_round_half_up_equals_round(spark):
    odd = [0.0, -0.0, 1e-9, -1e-9, 0.5e-6, 1.0000005, -1.0000005, 2.5e-6, 1e300, -1e18, 123456789.1234565, float("inf"), float("nan"), None]
    rng = np.random.default_rng(5)
    odd += (rng.normal(0, 1, 3000) * 10.0 ** rng.integers(-8, 12, 3000)).tolist()
    odd += [round(x, 7) for x in (rng.integers(0, 10**9, 3000) * 10 + 5) / 1e7]
    df = spark.createDataFrame([(None if x is None else float(x),) for x in odd], "x double")
    for places in (4, 6):
        rows = df.select(round_half_up("x", places).alias("a"), F.round("x", places).alias("b"))
        assert rows.filter("not (cast(a as string) <=> cast(b as string))").count() == 0


def test_means_of_a_chunk_whose_positions_count_a_row_without_a_date(spark):
    rows = bar_rows("A", range(1, 71))
    undated = [(s, None, *rest) for s, _, *rest in bar_rows("A", [5.0])]
    found = ind.moving_averages(bars_frame(spark, rows + undated), chunk_rows=64).orderBy("pos").collect()
    assert [r["pos"] for r in found] == list(range(1, 71))
    assert found[18]["MA20"] == pytest.approx(10.0) and found[48]["MA50"] == pytest.approx(25.0)
    assert found[69]["MA20"] == pytest.approx(60.5) and found[17]["MA20"] is None
