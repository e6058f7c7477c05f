"""Indicators extended day by day against indicators of the whole series."""

import datetime as dt

import numpy as np
import pytest
from frames import DAY0, bar_rows, bars_frame
from pyspark.sql import functions as F

from barloom.functions.series import CHUNK_ROWS
from barloom.operators import incremental
from barloom.operators import indicators as ind
from barloom.schemas import INDICATOR_COLUMNS, STOCK_INDICATORS
from barloom.session import cut_lineage
from barloom.sources.store import TableStore

NAMES = STOCK_INDICATORS.fieldNames()


def closes(seed, n):
    return np.round(np.maximum(50 + np.random.default_rng(seed).normal(0, 1, n).cumsum(), 0.5), 2)


def values(df, names=NAMES):
    return {(r["tradingsymbol"], r["date"]): tuple(r) for r in df.select(*names).collect()}


def same(found, expected):
    assert found.keys() == expected.keys()
    for key, row in expected.items():
        for name, a, b in zip(NAMES, found[key], row):
            if name in INDICATOR_COLUMNS and b is not None:
                assert a == pytest.approx(b, abs=1e-7), (key, name)
            else:
                assert a == b, (key, name)


@pytest.fixture(scope="module")
def bars(spark):
    series = [bar_rows("A", closes(1, 130)), bar_rows("FLAT", [7.0] * 60), bar_rows("ONE", [3.0])]
    series += [bar_rows("LATE", closes(2, 40), DAY0 + dt.timedelta(days=80)), bar_rows("GAP", closes(3, 45), step=3)]
    zero = closes(4, 90)
    zero[30] = 0.0
    return cut_lineage(bars_frame(spark, *series, bar_rows("ZERO", zero)), "bars")


@pytest.fixture(scope="module")
def whole(bars):
    return values(ind.indicators(bars))


@pytest.mark.parametrize("cuts, chunk_rows", [((40, 41), CHUNK_ROWS), ((90,), 50)])
def test_any_split_gives_the_whole_history(spark, store, bars, whole, cuts, chunk_rows):
    bounds = [DAY0, *[DAY0 + dt.timedelta(days=c) for c in cuts], dt.date(2100, 1, 1)]
    for low, high in zip(bounds, bounds[1:]):
        part = bars.filter((F.col("date") >= F.lit(low)) & (F.col("date") < F.lit(high)))
        incremental.extend_indicators(store, part, chunk_rows)
    incremental.extend_indicators(store, bars.limit(50), chunk_rows)  # known bars change nothing
    same(values(store.read("stock_indicators")), whole)
    latest = values(incremental.maintained_latest(store), [*NAMES, "previous_OBV"])
    expected = values(ind.latest_bar(bars), [*NAMES, "previous_OBV"])
    same({k: v[:-1] for k, v in latest.items()}, {k: v[:-1] for k, v in expected.items()})
    assert {k: v[-1] for k, v in latest.items()} == {k: v[-1] for k, v in expected.items()}
    assert ("ONE", DAY0) not in latest and store.read("stock_latest").count() == 6
    sizes = store.read("indicator_state").select("tradingsymbol", "n_rows", F.size("tail")).collect()
    assert {(s, n, min(n, ind.HISTORY)) for s, n, _ in sizes} == {tuple(r) for r in sizes}


def test_a_day_reads_no_history(spark, store, bars):
    day = DAY0 + dt.timedelta(days=129)
    incremental.extend_indicators(store, bars.filter(F.col("date") < F.lit(day)))
    new = cut_lineage(bars.filter(F.col("date") == F.lit(day)), "new")
    rows = incremental.extended_rows(new, store.read("indicator_state"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "indicator_state" in plan and "stock_timeseries" not in plan and "stock_indicators" not in plan
    assert rows.count() == (1 + ind.HISTORY) + (1 + 43)  # A and GAP have a new bar; the others are not touched
    latest = incremental.maintained_latest(store)._jdf.queryExecution().executedPlan().toString()
    assert "stock_latest" in latest and "Window" not in latest and "Exchange" not in latest


def test_a_broken_extension_can_be_repeated(spark, tmp_path, bars, whole, monkeypatch):
    cut = DAY0 + dt.timedelta(days=70)
    for step in ("append", "stock_latest", "indicator_state"):
        store = TableStore(spark, f"broken_{step}", str(tmp_path / step))
        incremental.extend_indicators(store, bars.filter(F.col("date") < F.lit(cut)))

        def fail(*_):
            raise RuntimeError("killed")

        def replace(table, df, plain=store.replace):
            fail() if table == step else plain(table, df)

        with monkeypatch.context() as patch:
            patch.setattr(store, *(("append", fail) if step == "append" else ("replace", replace)))
            with pytest.raises(RuntimeError, match="killed"):
                incremental.extend_indicators(store, bars)
        incremental.extend_indicators(store, bars)
        same(values(store.read("stock_indicators")), whole)


def test_nothing_to_extend(spark, store, bars):
    incremental.extend_indicators(store, bars.limit(0))
    assert incremental.maintained_latest(store).count() == 0 and not store.exists("stock_indicators")


def test_a_first_load_leaves_no_copies_of_all_rows(spark, store, bars, monkeypatch):
    """Besides the table only rows per symbol are written, and the rows are shuffled by nothing but their symbol."""
    plan = incremental.extended_rows(bars, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    written, appended = [], []

    def noted(df, label="stage"):
        written.append(df.count())
        return cut_lineage(df, label)

    def append(table, df, gather=True, plain=store.append):
        appended.append(df._jdf.queryExecution().executedPlan().toString())
        plain(table, df, gather)
        assert not gather

    monkeypatch.setattr(incremental, "cut_lineage", noted)
    monkeypatch.setattr(store, "append", append)
    incremental.extend_indicators(store, bars)
    assert written == [6] and "Join" not in appended[0]
