"""Greedy selection against picking by striking out."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from frames import DAY0, bar_rows, bars_frame

from barloom.operators import selection
from barloom.operators.indicators import daily_returns

RANKED = "tradingsymbol string, score double, sector string, latest_close double"


def correlated(a, b, threshold):
    """Pearson's r of two dicts over the keys they share, compared by magnitude."""
    shared = sorted(a.keys() & b.keys())
    if len(shared) < 2:
        return False
    mean_a, mean_b = (sum(d[k] for k in shared) / len(shared) for d in (a, b))
    across = sum((a[k] - mean_a) * (b[k] - mean_b) for k in shared)
    own_a, own_b = (sum((d[k] - m) ** 2 for k in shared) for d, m in ((a, mean_a), (b, mean_b)))
    return own_a > 0 and own_b > 0 and abs(across) >= threshold * (own_a * own_b) ** 0.5


def best_set(ranked, closes, top_n, threshold, align, max_per_sector=None):
    """Picks by striking out: the best remaining symbol is picked, and all that clash with it go."""
    moves = {}
    for symbol, rows in closes.items():
        ordered = sorted(rows)
        steps = enumerate(zip(ordered, ordered[1:]))
        moves[symbol] = {
            (day if align == "date" else n): now / before - 1 for n, ((_, before), (day, now)) in steps
        }
    sectors = {symbol: sector for symbol, _, sector, _ in ranked}
    left = {symbol: score for symbol, score, _, _ in ranked if symbol in moves}
    picks = []
    while left and len(picks) < top_n:
        best = min(left, key=lambda s: (left[s] is None, -(left[s] or 0.0), s))
        picks.append(best)
        full = max_per_sector and sum(sectors[p] == sectors[best] for p in picks) >= max_per_sector
        struck = {best} | {s for s in left if correlated(moves[s], moves[best], threshold)}
        struck |= {s for s in left if full and sectors[s] == sectors[best]}
        left = {s: score for s, score in left.items() if s not in struck}
    return picks


def market(seed, symbols, days=40):
    """Prices driven by a few common factors, so many pairs are correlated."""
    rng = np.random.default_rng(seed)
    factors = rng.normal(0, 1, (4, days))
    bars, closes, ranked = [], {}, []
    for i in range(symbols):
        move = factors[i % 4] * rng.uniform(0.2, 2) + rng.normal(0, 1, days)
        length = int(rng.integers(days - 8, days + 1))
        prices = np.round(100 * np.exp(0.01 * move[:length].cumsum()), 4).tolist()
        start = DAY0 + dt.timedelta(days=int(rng.integers(0, 4)))
        rows = bar_rows(f"S{i:03d}", prices, start=start)
        bars.append(rows)
        closes[f"S{i:03d}"] = [(r[1], r[5]) for r in rows]
        score = None if i % 13 == 0 else float(rng.integers(0, 15))
        ranked.append((f"S{i:03d}", score, f"sector{i % 5}" if i % 7 else None, prices[-1]))
    ranked.append(("NOBARS", 99.0, "sector0", 1.0))
    return bars, closes, ranked


@pytest.mark.parametrize("align", ["position", "date"])
@pytest.mark.parametrize("block, threshold", [(64, 0.3), (5, 0.3), (3, 0.15), (1, 0.5)])
def test_equals_the_loop(spark, align, block, threshold):
    bars, closes, ranked = market(block * 7, 40)
    got = selection.select_top(
        spark.createDataFrame(ranked, RANKED),
        bars_frame(spark, *bars),
        top_n=8,
        correlation_threshold=threshold,
        align=align,
        block=block,
    )
    symbols = [r["tradingsymbol"] for r in got.orderBy("pick_no").collect()]
    assert symbols == best_set(ranked, closes, 8, threshold, align)


@pytest.mark.parametrize("block", [64, 4])
def test_sector_limit(spark, block):
    bars, closes, ranked = market(3, 30)
    got = selection.select_top(
        spark.createDataFrame(ranked, RANKED),
        bars_frame(spark, *bars),
        top_n=6,
        correlation_threshold=0.4,
        max_per_sector=1,
        block=block,
    )
    symbols = [r["tradingsymbol"] for r in got.orderBy("pick_no").collect()]
    assert symbols == best_set(ranked, closes, 6, 0.4, "position", max_per_sector=1)


def test_chunked_series_select_the_same(spark):
    bars, closes, ranked = market(11, 25, days=60)
    got = selection.select_top(
        spark.createDataFrame(ranked, RANKED),
        bars_frame(spark, *bars),
        top_n=5,
        correlation_threshold=0.3,
        chunk_rows=16,
        block=6,
    )
    symbols = [r["tradingsymbol"] for r in got.orderBy("pick_no").collect()]
    assert symbols == best_set(ranked, closes, 5, 0.3, "position")


def test_ties_and_repeated_rows(spark):
    bars = bars_frame(
        spark, bar_rows("B", [1, 2, 1, 3, 1.5]), bar_rows("A", [5, 4, 9, 4, 4.5])
    )
    rows = [("B", 1.0, None, 1.0), ("A", 1.0, None, 1.0), ("B", 1.0, None, 1.0)]
    got = selection.select_top(
        spark.createDataFrame(rows, RANKED), bars, top_n=2, correlation_threshold=1.1
    )
    assert [tuple(r) for r in got.orderBy("pick_no").collect()] == [(1, "A"), (2, "B")]


def test_correlation_equals_pandas(spark):
    bars, closes, _ = market(5, 12)
    bars.append(bar_rows("FLAT", [7.0] * 30))
    bars.append(bar_rows("TWO", [7.0, 8.0]))
    closes["FLAT"] = [(r[1], r[5]) for r in bars[-2]]
    closes["TWO"] = [(r[1], r[5]) for r in bars[-1]]
    for align in ("position", "date"):
        returns = daily_returns(bars_frame(spark, *bars))
        few = returns.filter("tradingsymbol in ('S000', 'S001', 'FLAT')")
        got = selection.return_correlation(returns, few, align)
        pairs = {(r["tradingsymbol"], r["other"]): r["correlation"] for r in got.collect()}
        series = {}
        for symbol, rows in closes.items():
            frame = pd.DataFrame(sorted(rows), columns=["date", "close"])
            frame = frame.set_index("date") if align == "date" else frame
            series[symbol] = frame["close"].pct_change().dropna()
        assert ("S000", "S000") not in pairs
        for (a, b), value in pairs.items():
            both = pd.concat([series[a], series[b]], axis=1, join="inner")
            with np.errstate(all="ignore"):
                want = both.iloc[:, 0].corr(both.iloc[:, 1])
            if np.isnan(want):
                assert value is None
            else:
                assert value == pytest.approx(want, abs=1e-12)


def test_correlation_without_broadcast(spark, monkeypatch):
    bars, _, _ = market(6, 8)
    returns = daily_returns(bars_frame(spark, *bars))
    few = returns.filter("tradingsymbol = 'S003'")
    one = selection.return_correlation(returns, few).orderBy("tradingsymbol").collect()
    monkeypatch.setattr(selection, "BROADCAST_RETURNS", 0)
    two = selection.return_correlation(returns, few).orderBy("tradingsymbol").collect()
    assert [r["n_common"] for r in one] == [r["n_common"] for r in two]
    assert [r["correlation"] for r in one] == pytest.approx([r["correlation"] for r in two])


def test_candidates_do_not_multiply(spark):
    scores = spark.createDataFrame(
        [(DAY0, "A", 5.0, 10.0), (DAY0, "B", 6.0, 10.01), (DAY0, "C", 1.0, None)],
        "Date_Update date, tradingsymbol string, score double, latest_close double",
    )
    later = DAY0 + dt.timedelta(days=1)
    sectors = spark.createDataFrame(
        [(DAY0, "A", "old"), (later, "A", "new"), (later, "A", "new")],
        "Date_Update date, tradingsymbol string, sector string",
    )
    names = spark.createDataFrame([("A", "n"), ("A", "n")], "tradingsymbol string, name string")
    rows = selection.candidates(scores, sectors, names, 10.0).collect()
    assert [tuple(r) for r in rows] == [(DAY0, "A", "n", "new", 5.0, 10.0)]
