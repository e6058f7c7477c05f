"""Technical indicators per symbol.

Every function takes bars (``tradingsymbol, date, open, high, low, close, volume``, one row per symbol
and date, ``close`` not null) and returns them with ``pos`` and the indicator columns. ``longest`` is
the length of the longest series when known (see ``functions.series``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio_change
from barloom.functions.series import (
    CHUNK,
    CHUNK_ROWS,
    DATE,
    POS,
    SYMBOL,
    TOTAL,
    SeriesFrame,
    Steps,
    carry_depth,
    ema_decay,
    series_frame,
)
from barloom.schemas import INDICATOR_COLUMNS
from barloom.session import cut_lineage

# fixed values: window lengths and spans of the indicators
MA_SHORT, MA_LONG = 20, 50
RSI_ROWS, ATR_ROWS = 14, 14
FAST_SPAN, SLOW_SPAN, SIGNAL_SPAN = 12, 26, 9
VOLUME_ROWS, WEEK_ROWS, MONTH_ROWS = 20, 5, 22
# rows of the parts that these lengths are put together from
MEAN_PART, FORTNIGHT_PART, MONTH_PART = 10, 7, 11

HISTORY = MA_LONG - 1
# the two averages behind MACD, as they stand after a row
FAST_END, SLOW_END = "_fast_end", "_slow_end"


# Each indicator is a list of steps: 0 looks at earlier rows, 1 combines them, 2 rolls parts or accumulates
# over rows, 3 puts parts together, 4 builds on the rolled values. Steps of several indicators are merged.


def _before(frame: SeriesFrame) -> dict[str, Column]:
    return {"_before": frame.previous("close")}


def _move() -> Column:
    return F.col("close") - F.col("_before")


def _moving_averages(frame: SeriesFrame) -> Steps:
    sums = {"_close_part": frame.part(F.sum, "close", MEAN_PART)}
    # a position may count rows without a date, which are no rows of a chunk
    means = {
        name: F.when(
            F.col(POS) >= rows - 1,
            frame.over_parts("_close_part", MEAN_PART, rows // MEAN_PART) / F.least(F.col("_seen"), F.lit(rows)),
        )
        for name, rows in (("MA20", MA_SHORT), ("MA50", MA_LONG))
    }
    return [{"_seen": F.row_number().over(frame.window)}, {}, sums, means]


def _rsi(frame: SeriesFrame) -> Steps:
    move = _move()
    # greatest/least skip NULL, so the first row is kept NULL explicitly
    moves = {
        "_gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))),
        "_loss": F.when(move.isNotNull(), -F.least(move, F.lit(0.0))),
    }
    sums = {f"_{kind}_part": frame.part(F.sum, f"_{kind}", FORTNIGHT_PART) for kind in ("gain", "loss")}
    full, parts = F.col(POS) >= RSI_ROWS, RSI_ROWS // FORTNIGHT_PART
    means = {
        f"_avg_{kind}": F.when(full, frame.over_parts(f"_{kind}_part", FORTNIGHT_PART, parts) / F.lit(float(RSI_ROWS)))
        for kind in ("gain", "loss")
    }
    gain, loss = F.col("_avg_gain"), F.col("_avg_loss")
    strength = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(gain, loss))
    rsi = F.when((loss == 0) & (gain > 0), F.lit(100.0)).when(loss > 0, strength)
    return [_before(frame), moves, sums, means, {"RSI14": rsi}]


def _atr(frame: SeriesFrame) -> Steps:
    high, low, before = F.col("high"), F.col("low"), F.col("_before")
    # greatest skips NULL: the first row of a series uses high - low alone
    true_range = F.greatest(high - low, F.abs(high - before), F.abs(low - before))
    sums = _counted_sums(frame, "_range", FORTNIGHT_PART)
    mean = {"ATR14": _mean_of_parts(frame, "_range", FORTNIGHT_PART, ATR_ROWS)}
    return [_before(frame), {"_range": true_range}, sums, mean]


def _counted_sums(frame: SeriesFrame, column: str, rows: int) -> dict[str, Column]:
    return {f"{column}_part": frame.part(F.sum, column, rows), f"{column}_count": frame.part(F.count, column, rows)}


def _mean_of_parts(frame: SeriesFrame, column: str, part: int, rows: int) -> Column:
    """Mean of the last ``rows`` values from parts of ``part`` rows; NULL until that many non-null ones are there."""
    full = frame.over_parts(f"{column}_count", part, rows // part) == rows
    return F.when(full, frame.over_parts(f"{column}_part", part, rows // part) / F.lit(float(rows)))


def _liquidity_volatility(frame: SeriesFrame) -> Steps:
    daily = {"_return": ratio_change(F.col("close"), F.col("_before"))}
    parts = {
        **_counted_sums(frame, "volume", MEAN_PART),
        **_counted_sums(frame, "_return", MONTH_PART),
        "_return_spread": frame.part(F.var_pop, "_return", MONTH_PART),
    }
    # squares about the mean of all rows: those about the means of both halves, and the distance of these means
    spread = frame.over_parts("_return_spread", MONTH_PART, 2) * F.lit(float(MONTH_PART))
    apart = (F.col("_return_part") - frame.previous("_return_part", MONTH_PART)) / F.lit(float(MONTH_PART))
    squares = spread + apart * apart * F.lit(MONTH_PART / 2.0)
    full = frame.over_parts("_return_count", MONTH_PART, 2) == MONTH_ROWS
    rolled = {
        "avg_daily_volume": _mean_of_parts(frame, "volume", MEAN_PART, VOLUME_ROWS),
        "volatility_1m": F.when(full, F.sqrt(squares / F.lit(MONTH_ROWS - 1.0))),
    }
    return [_before(frame), daily, parts, rolled]


def _price_changes(frame: SeriesFrame) -> Steps:
    changes = {
        "price_change_1w": frame.change("close", WEEK_ROWS),
        "price_change_1m": frame.change("close", MONTH_ROWS),
    }
    return [changes]


def _local_obv(frame: SeriesFrame) -> Steps:
    signed = F.coalesce(F.signum(_move()) * F.col("volume"), F.lit(0.0))
    sums = {
        "_obv": frame.running_sum(F.col("_signed")),
        "_obv_before": F.coalesce(frame.running_sum(F.col("_signed"), until=-1), F.lit(0.0)),
    }
    return [_before(frame), {"_signed": signed}, sums]


def _local_macd(frame: SeriesFrame) -> Steps:
    close = F.col("close").cast("double")
    averages = {
        "_fast": frame.running_ema(close, FAST_SPAN),
        "_slow": frame.running_ema(close, SLOW_SPAN),
    }
    signal = {"_signal": frame.running_ema(F.col("_fast") - F.col("_slow"), SIGNAL_SPAN)}
    return [{}, {}, averages, signal]


def _lagged_response(span: int, steps: Column | int) -> Column | float:
    """Signal-average response, ``steps`` rows on, to an average of ``span`` decaying from 1.

    ``(1 - r) * sum(r^(n-i) * q^i, i = 1..n)`` with ``q`` the decay of ``span`` and ``r`` that of the
    signal, as a closed form.
    """
    q, r = ema_decay(span), ema_decay(SIGNAL_SPAN)
    factor = (1.0 - r) * q / (r - q)
    if isinstance(steps, int):
        return factor * (r**steps - q**steps)
    return F.lit(factor) * (F.pow(F.lit(r), steps) - F.pow(F.lit(q), steps))


def _macd_carry(chunk_rows: int, by_chunk) -> Column:
    """State of the three averages at the end of each chunk, folded over the chunks before it.

    Older chunks than the frame reaches have decayed below the smallest double.
    """
    depth = carry_depth(SLOW_SPAN, chunk_rows)
    ends = F.collect_list(F.struct("_fast", "_slow", "_signal")).over(
        by_chunk.rowsBetween(-depth, 0)
    )
    fast, slow, signal = (ema_decay(s) ** chunk_rows for s in (FAST_SPAN, SLOW_SPAN, SIGNAL_SPAN))
    fast_in = _lagged_response(FAST_SPAN, chunk_rows)
    slow_in = _lagged_response(SLOW_SPAN, chunk_rows)

    def step(state: Column, end: Column) -> Column:
        return F.struct(
            (end["_fast"] + fast * state["fast"]).alias("fast"),
            (end["_slow"] + slow * state["slow"]).alias("slow"),
            (
                end["_signal"]
                + signal * state["signal"]
                + fast_in * state["fast"]
                - slow_in * state["slow"]
            ).alias("signal"),
        )

    start = F.struct(*[F.lit(0.0).alias(name) for name in ("fast", "slow", "signal")])
    return F.aggregate(ends, start, step)


def _carries(ends: DataFrame, chunk_rows: int, obv: bool, macd: bool) -> DataFrame:
    """State to start each chunk with, one row per (symbol, chunk) after the first.

    ``ends`` are the last rows of full chunks: a window per symbol holds one row for every ``chunk_rows``.
    """
    by_chunk = Window.partitionBy(SYMBOL).orderBy(CHUNK)
    carries: list[Column] = []
    if obv:
        total = F.sum("_obv").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0))
        carries.append(total.alias("_obv_carry"))
    if macd:
        carries.append(_macd_carry(chunk_rows, by_chunk).alias("_macd_carry"))
    return ends.select(SYMBOL, CHUNK, *carries).withColumn(CHUNK, F.col(CHUNK) + 1)


def _complete(
    frame: SeriesFrame, names: list[str], obv: bool = False, macd: bool = False
) -> DataFrame:
    """The columns ``names`` with chunk-local running values turned into values of the whole series.

    Rows of a chunked frame are worked out twice, first with nothing but the running values, for the state at the end of each
    chunk. Written with their windows done they would take a multiple of the disk of the bars they come from.
    """
    rows = frame.rows()
    if frame.chunked:
        running = (["_obv", "_obv_before"] if obv else []) + (["_fast", "_slow", "_signal"] if macd else [])
        rows = rows.select(*names, CHUNK, *running)
        ends = rows.filter(frame.offset == frame.chunk_rows - 1)
        # written, so that its size is known: small ones are broadcast and the rows stay where they are
        carries = cut_lineage(_carries(ends, frame.chunk_rows, obv, macd), "carries")
        rows = rows.join(carries, [SYMBOL, CHUNK], "left")
    return with_carries(frame, rows, obv, macd)


def with_carries(frame: SeriesFrame, rows: DataFrame, obv: bool = True, macd: bool = True) -> DataFrame:
    """Add what ``_obv_carry`` and ``_macd_carry`` bring from before a chunk, decayed by the rows since."""
    if obv:
        extra = F.coalesce(F.col("_obv_carry"), F.lit(0.0)) if frame.chunked else F.lit(0.0)
        rows = rows.withColumns(
            {"OBV": F.col("_obv") + extra, "previous_OBV": F.col("_obv_before") + extra}
        )
    if macd:
        fast, slow, signal = F.col("_fast"), F.col("_slow"), F.col("_signal")
        if frame.chunked:
            steps = frame.offset + 1

            def carried(name: str) -> Column:
                return F.coalesce(F.col(f"_macd_carry.{name}"), F.lit(0.0))

            def decayed(span: int) -> Column:
                return F.pow(F.lit(ema_decay(span)), steps)

            fast = fast + decayed(FAST_SPAN) * carried("fast")
            slow = slow + decayed(SLOW_SPAN) * carried("slow")
            signal = (
                signal
                + decayed(SIGNAL_SPAN) * carried("signal")
                + _lagged_response(FAST_SPAN, steps) * carried("fast")
                - _lagged_response(SLOW_SPAN, steps) * carried("slow")
            )
        rows = rows.withColumns(
            {"MACD": fast - slow, "MACD_signal": signal, FAST_END: fast, SLOW_END: slow}
        )
    return rows


def _keep(bars: DataFrame, rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*bars.columns, POS, *names)


def moving_averages(
    bars: DataFrame, longest: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """20- and 50-row means of ``close``."""
    frame = series_frame(bars, HISTORY, longest, chunk_rows)
    frame = frame.with_steps(_moving_averages(frame))
    return _keep(bars, frame.rows(), "MA20", "MA50")


def rsi14(bars: DataFrame, longest: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Relative strength from simple 14-row means of gains and losses."""
    frame = series_frame(bars, RSI_ROWS, longest, chunk_rows)
    frame = frame.with_steps(_rsi(frame))
    return _keep(bars, frame.rows(), "RSI14")


def atr14(bars: DataFrame, longest: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """14-row mean of the true range."""
    frame = series_frame(bars, ATR_ROWS, longest, chunk_rows)
    frame = frame.with_steps(_atr(frame))
    return _keep(bars, frame.rows(), "ATR14")


def macd(bars: DataFrame, longest: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Difference of the 12- and 26-row exponential averages, and its 9-row exponential average."""
    frame = series_frame(bars, 1, longest, chunk_rows)
    rows = _complete(frame.with_steps(_local_macd(frame)), [*bars.columns, POS], macd=True)
    return _keep(bars, rows, "MACD", "MACD_signal")


def obv(bars: DataFrame, longest: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Running volume signed by the direction of ``close``; 0 on the first row."""
    frame = series_frame(bars, 1, longest, chunk_rows)
    rows = _complete(frame.with_steps(_local_obv(frame)), [*bars.columns, POS], obv=True)
    return _keep(bars, rows, "OBV")


def liquidity_volatility(
    bars: DataFrame, longest: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """20-row mean volume and 22-row sample deviation of daily returns."""
    frame = series_frame(bars, MONTH_ROWS, longest, chunk_rows)
    frame = frame.with_steps(_liquidity_volatility(frame))
    return _keep(bars, frame.rows(), "avg_daily_volume", "volatility_1m")


def price_changes(
    bars: DataFrame, longest: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Relative change of ``close`` over 5 and 22 rows."""
    frame = series_frame(bars, MONTH_ROWS, longest, chunk_rows)
    frame = frame.with_steps(_price_changes(frame))
    return _keep(bars, frame.rows(), "price_change_1w", "price_change_1m")


def all_steps(frame: SeriesFrame) -> list[Steps]:
    """The steps of all eleven indicators."""
    return [
        _moving_averages(frame),
        _rsi(frame),
        _atr(frame),
        _local_macd(frame),
        _local_obv(frame),
        _liquidity_volatility(frame),
        _price_changes(frame),
    ]


def indicator_history(
    bars: DataFrame, longest: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """All eleven indicator columns, the previous row's OBV and whether the row is its symbol's last.

    The last row is known from the series length or from having no successor, so the latest bars can
    be filtered out of the stored result without grouping it again.
    """
    frame = series_frame(bars, HISTORY, longest, chunk_rows)
    if frame.chunked:
        is_last = F.col(POS) == F.col(TOTAL) - 1
    else:
        is_last = F.lead(DATE).over(frame.window).isNull()
    frame = frame.with_steps([{"is_last": is_last}], *all_steps(frame))
    done = [name for name in INDICATOR_COLUMNS if name not in ("OBV", "MACD", "MACD_signal")]
    rows = _complete(frame, [*bars.columns, POS, *done, "is_last"], obv=True, macd=True)
    return _keep(bars, rows, *INDICATOR_COLUMNS, "previous_OBV", "is_last")


def indicators(
    bars: DataFrame, longest: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """All eleven indicator columns from one layout of the series."""
    return indicator_history(bars, longest, chunk_rows).drop("previous_OBV", "is_last")


def last_rows(history: DataFrame) -> DataFrame:
    """The last bar of each symbol in an indicator history; symbols with one bar only are left out."""
    return history.filter(F.col("is_last") & (F.col(POS) >= 1)).drop("is_last")


def latest_bar(
    bars: DataFrame, longest: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The last bar of each symbol with its indicators and the previous row's OBV."""
    return last_rows(indicator_history(bars, longest, chunk_rows))


def daily_returns(
    bars: DataFrame, longest: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """(tradingsymbol, date, pos, daily_return); ``pos`` is numbered before null returns are dropped."""
    frame = series_frame(bars.select(SYMBOL, DATE, "close"), 1, longest, chunk_rows)
    frame = frame.with_steps([{"daily_return": frame.change("close")}])
    rows = frame.rows().select(SYMBOL, DATE, POS, "daily_return")
    return rows.filter(F.col("daily_return").isNotNull())
