"""The physical plans: shuffles, pushed filters, no Python, no cross joins."""

import re

import numpy as np
import pytest
from frames import bar_rows, bars_frame

from barloom.operators import indicators as ind
from barloom.operators import selection
from barloom.session import cut_lineage


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bars(spark):
    rows = [
        bar_rows(f"S{i}", np.round(50 + np.random.default_rng(i).normal(0, 1, 80).cumsum(), 2))
        for i in range(6)
    ]
    return cut_lineage(bars_frame(spark, *rows), "bars")


def test_indicators_shuffle_once(bars):
    plan = plan_of(ind.indicators(bars, longest=80))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    # row look-backs, rolling values, signal average
    assert len(re.findall(r"\bWindow \[", plan)) == 3


def test_single_indicators_read_only_their_columns(bars):
    assert "ReadSchema: struct<tradingsymbol:string,date:date,close:double>" in plan_of(
        ind.moving_averages(bars, longest=80).select("tradingsymbol", "date", "MA50")
    )


def test_chunked_windows_never_span_a_series(bars):
    """Bars are only ever grouped by (symbol, year) and (symbol, chunk)."""
    plan = plan_of(ind.moving_averages(bars, chunk_rows=64))
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            rows_of_summary = "_rows" in line
            by_part = re.search(r"windowspecdefinition\(tradingsymbol#\d+, _(year|chunk)#\d+", line)
            assert rows_of_summary or by_part


def test_chunks_are_sent_packed_and_their_rows_not_written(bars, monkeypatch):
    """On disk a chunk's rows are neither written with all indicators nor shuffled one by one."""
    written = []
    monkeypatch.setattr(ind, "cut_lineage", lambda df, label: written.append(df.columns) or cut_lineage(df, label))
    plan = plan_of(ind.indicators(bars, chunk_rows=64))
    assert written == [["tradingsymbol", "_chunk", "_obv_carry", "_macd_carry"]]
    sent = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\(tradingsymbol#\d+, _chunk#", line)]
    # the packed rows, and the carries where they are not broadcast
    assert sum("REPARTITION_BY_COL" in line for line in sent) == 1 and len(sent) <= 2
    assert plan.index("Generate inline(_packed") < plan.index("REPARTITION_BY_COL")


def test_selected_symbols_are_pushed_to_the_scan(bars):
    returns = ind.daily_returns(bars, longest=80).filter("tradingsymbol in ('S1', 'S2')")
    assert "In(tradingsymbol, [S1,S2])" in plan_of(returns)


def test_selected_symbols_are_pushed_below_the_packing(bars):
    returns = ind.daily_returns(bars, chunk_rows=64).filter("tradingsymbol in ('S1', 'S2')")
    assert "In(tradingsymbol, [S1,S2])" in plan_of(returns)


def test_correlation_aggregates_before_its_shuffle(bars):
    returns = ind.daily_returns(bars, longest=80)
    few = returns.filter("tradingsymbol = 'S1'")
    plan = plan_of(selection.return_correlation(returns, few, other_rows=80))
    assert "BroadcastHashJoin" in plan
    assert "partial_covar_samp" in plan


def test_look_backs_slide_over_short_parts(bars):
    """A sliding frame is computed anew for each row, so 50 rows are put together from parts of 10."""
    plan = plan_of(ind.indicators(bars, longest=80))
    lengths = [int(n) for n in re.findall(r"RowFrame, -(\d+), currentrow\$?\(?\)?", plan)]
    assert lengths and max(lengths) < ind.MONTH_PART
