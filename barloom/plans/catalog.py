"""The registered queries: each operator over the driver's tables.

Thresholds follow the value ranges of those tables, because random prices leave the market defaults
without effect. Float columns are rounded so that two engines can be compared by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import round_half_up
from barloom.operators import indicators as ind
from barloom.operators import calendar, incremental, ingest, market, news, orders, scoring, sectors, selection, universe
from barloom.plans import daily
from barloom.schemas import STOCK_TIMESERIES
from barloom.session import cut_lineage, scratch_path
from barloom.sources import views
from barloom.sources.readers import read_instruments
from barloom.sources.store import TableStore
from barloom.streaming.event_time import event_time_bars
from barloom.streaming.ingest_stream import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

SHORT_RULES = scoring.ScoreRules(liquidity_scale=3.0, volatility_low=3.0, volatility_high=10.0)
LONG_RULES = scoring.ScoreRules(liquidity_scale=30.0, volatility_low=0.3, volatility_high=0.5)
SHORT_PRICE_LIMIT = 30.0
SHORT_THRESHOLD = 0.25
SECTOR_LABELS = ["AUTOMOBILE", "BUILDING", "MACHINERY"]


BAR_COLUMNS = ["open", "high", "low", "close", "volume"]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Computed double columns rounded for comparison between engines; bar columns are exact as they are."""
    computed = {name for name, kind in df.dtypes if kind == "double"} - set(BAR_COLUMNS)
    return df.select(
        *[
            round_half_up(name, places).alias(name) if name in computed else F.col(name)
            for name in df.columns
        ]
    )


def scratch_store(spark: SparkSession) -> TableStore:
    """An empty store in the shared scratch folder."""
    name = f"barloom_{uuid.uuid4().hex[:12]}"
    return TableStore(spark, name, scratch_path(spark, name))


def universe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.universe_filter(views.instruments(spark, sf_dir), views.SHORT_AS_OF)


def universe_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_store(spark)
    return universe.universe_snapshot(store, views.instruments(spark, sf_dir), views.SHORT_AS_OF)


def instrument_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = (
        views.table(spark, sf_dir, "events")
        .select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("tradingsymbol"),
            F.lit("NSE").alias("exchange"),
        )
        .distinct()
    )
    return universe.instrument_lookup(requests, views.instruments(spark, sf_dir))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bars_short(spark, sf_dir)


def daily_bars_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bars_long(spark, sf_dir)


def ingest_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_watermark(views.stored_bars(spark, sf_dir))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock_list = universe_filter(spark, sf_dir)
    return ingest.ingest_plan(stock_list, views.stored_bars(spark, sf_dir), views.SHORT_AS_OF)


def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


def ingest_new_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = cut_lineage(_plan(spark, sf_dir), "plan")
    ticks = views.event_ticks(views.table(spark, sf_dir, "events"))
    bars = ingest.daily_bars(ingest.planned_ticks(ticks, plan, views.SHORT_AS_OF))
    return ingest.ingest_new_bars(bars, plan)


def intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = views.event_ticks(views.table(spark, sf_dir, "events"))
    return ingest.interval_bars(ticks, "60minute")


def universe_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe of an instrument list that has landed as CSV files."""
    path = scratch_path(spark, "instruments-csv")
    views.instruments(spark, sf_dir).write.csv(path, header=True)
    return universe.universe_filter(read_instruments(spark, path), views.SHORT_AS_OF)


def ingest_new_bars_min2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history lacks one bar of even users, who are skipped, and two of the rest."""
    stored = views.stored_bars_but_one(spark, sf_dir)
    plan = ingest.ingest_plan(universe_filter(spark, sf_dir), stored, views.SHORT_AS_OF)
    return ingest.ingest_new_bars(views.bars_short(spark, sf_dir), plan, min_new_bars=2)


def _streamed(spark: SparkSession, sf_dir: str) -> TableStore:
    """Load ``events``, landed as files that split days and arrive out of order, one file a batch, into a store
    that already holds earlier bars."""
    store = scratch_store(spark)
    store.append("stock_timeseries", views.stored_bars(spark, sf_dir))
    events = views.table(spark, sf_dir, "events")
    landed = scratch_path(spark, "landed")
    events.repartition(4, F.pmod(F.xxhash64("event_id"), F.lit(4))).write.parquet(landed)
    ingest_stream(
        spark,
        landed,
        events.schema,
        views.event_ticks,
        store,
        cut_lineage(universe_filter(spark, sf_dir), "universe"),
        views.SHORT_AS_OF,
        scratch_path(spark, "stream-state"),
        files_per_batch=1,
        open_days=0,
    )
    return store


def ingest_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).read("stock_timeseries")


def late_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream found for days that were stored before."""
    return _streamed(spark, sf_dir).read("late_bars").drop("stream", "run")


#: Days of ``events`` per landing in the event-time queries, and how far behind the newest tick a day stays open.
LANDED_DAYS = 10
EVENT_DELAY = "2 days"


def event_time_bars_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` landed ten days at a time, a run after each landing; every 20th event lands one run late. Days still in
    the state at the end are not in the result, nor are ticks that came after their day was closed."""
    events = views.table(spark, sf_dir, "events")
    number = F.floor(F.date_diff(F.to_date("ts"), F.lit(date(2024, 1, 1))) / LANDED_DAYS)
    number = number + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0)
    landed, sink, state = (scratch_path(spark, name) for name in ("landed", "closed-days", "event-time-state"))
    numbers = [row[0] for row in events.select(number.alias("n")).distinct().orderBy("n").collect()]
    for n in numbers:
        events.filter(number == n).write.mode("append").parquet(landed)
        event_time_bars(spark, landed, events.schema, views.event_ticks, sink, state, EVENT_DELAY)
    return spark.read.schema(STOCK_TIMESERIES).parquet(sink)


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from the opening at 09:15, without weekends and one holiday, empty intervals included."""
    ticks = views.event_ticks(views.table(spark, sf_dir, "events"))
    days = calendar.session_calendar(spark, date(2024, 1, 1), views.SHORT_AS_OF, 60, holidays=[date(2024, 1, 26)])
    return calendar.session_bars(ticks, days, 60)


def _stored_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long bars as a stored table: series are laid out from stored bars, which are read twice."""
    return cut_lineage(views.bars_long(spark, sf_dir), "bars")


def _stored_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(views.bars_short(spark, sf_dir), "bars")


def _indicator_query(operator: Callable[[DataFrame], DataFrame], columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = operator(_stored_long(spark, sf_dir))
        return rounded(rows.select("tradingsymbol", "date", "pos", *columns))

    return run


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.indicators(_stored_long(spark, sf_dir)))


def indicators_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of bars: every warm-up gap of the indicators shows."""
    return rounded(ind.indicators(_stored_short(spark, sf_dir)))


def indicators_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout for long series: chunks of 128 rows with context and carried state.

    Carried averages are summed in another order than a fold, which now and then turns the sixth decimal.
    """
    return rounded(ind.indicators(_stored_long(spark, sf_dir), chunk_rows=128), 4)


def latest_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.latest_bar(_stored_long(spark, sf_dir)))


def _extended(spark: SparkSession, sf_dir: str) -> TableStore:
    """The long bars, all but the last two days first, then day by day; one of the days is taken in twice."""
    store = scratch_store(spark)
    bars = _stored_long(spark, sf_dir)
    newest = bars.agg(F.max("date")).first()[0]
    days = [newest - timedelta(days=n) for n in (1, 1, 0)]
    incremental.extend_indicators(store, bars.filter(F.col("date") < F.lit(days[0])))
    for day in days:
        incremental.extend_indicators(store, bars.filter(F.col("date") == F.lit(day)))
    return store


def indicators_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indicators as a history that was extended day by day."""
    return rounded(_extended(spark, sf_dir).read("stock_indicators").withColumn("volume", F.col("volume").cast("double")))


def latest_bar_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bars as the daily extension keeps them."""
    latest = incremental.maintained_latest(_extended(spark, sf_dir))
    return rounded(latest.withColumn("volume", F.col("volume").cast("double")))


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = ind.latest_bar(_stored_long(spark, sf_dir))
    return rounded(scoring.score(latest, LONG_RULES))


def score_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = ind.latest_bar(_stored_short(spark, sf_dir))
    return rounded(scoring.score(latest, SHORT_RULES))


def _scored(bars: DataFrame, until: date) -> DataFrame:
    known = bars.filter(F.col("date") <= F.lit(until))
    return scoring.score(ind.latest_bar(known), SHORT_RULES)


def _store_both_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of scores, the second one stored twice."""
    store = scratch_store(spark)
    bars = _stored_short(spark, sf_dir)
    for day in (date(2024, 1, 29), views.SHORT_AS_OF, views.SHORT_AS_OF):
        stored = scoring.scores_snapshot(store, _scored(bars, day), day)
    return stored.select("Date_Update", "tradingsymbol", "score", "latest_close")


def scores_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store_both_days(spark, sf_dir)


def latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.latest_scores(_store_both_days(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    day = views.SHORT_AS_OF
    return selection.candidates(
        scoring.score_rows(_scored(bars, day), day),
        views.stock_sectors(spark, sf_dir),
        universe_filter(spark, sf_dir),
        SHORT_PRICE_LIMIT,
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, _stored_short(spark, sf_dir))


def _select(
    spark: SparkSession, sf_dir: str, **options: object
) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = _stored_short(spark, sf_dir)
    ranked = cut_lineage(_candidates(spark, sf_dir, bars), "candidates")
    picks = selection.select_top(
        ranked, bars, correlation_threshold=SHORT_THRESHOLD, **options
    )
    return ranked, bars, picks


def return_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol against the picked ones."""
    _, bars, picks = _select(spark, sf_dir)
    returns = ind.daily_returns(bars)
    picked = returns.join(picks, "tradingsymbol", "left_semi")
    return rounded(selection.return_correlation(returns, picked))


def return_correlation_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bars, picks = _select(spark, sf_dir)
    returns = ind.daily_returns(bars)
    picked = returns.join(picks, "tradingsymbol", "left_semi")
    return rounded(selection.return_correlation(returns, picked, align="date"))


def select_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir)[2]


def select_top_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, align="date")[2]


def select_top_one_per_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, max_per_sector=1)[2]


def top_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, _, picks = _select(spark, sf_dir)
    return selection.top_picks(ranked, picks, views.SHORT_AS_OF)


def unclassified_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors.unclassified_symbols(
        universe_filter(spark, sf_dir), views.stock_sectors(spark, sf_dir)
    )


def sector_prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors.sector_request_batches(
        unclassified_symbols(spark, sf_dir), batch_size=40, rows_per_bucket=100
    )


def sector_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors.sector_replies(views.replies(spark, sf_dir), views.SHORT_AS_OF, SECTOR_LABELS)


def sector_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors.rejected_replies(views.replies(spark, sf_dir)).select("batch_id")


def news_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = news.news_recency(views.news(spark, sf_dir), views.NEWS_AS_OF)
    return recent.select("name", "item_no", "title", "date", "article_time")


def news_recency_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = news.news_recency(
        views.news(spark, sf_dir), views.NEWS_AS_OF, max_articles=20, include_minutes=True
    )
    return recent.select("name", "item_no", "date", "article_time")


def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.lexicon_sentiment(views.news(spark, sf_dir), news.lexicon_table(spark, views.LEXICON))


def lexicon_sentiment_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that occurs is in the lexicon, with a valence that follows from its length."""
    items = views.news(spark, sf_dir)
    words = news.item_words(items).select("word").distinct()
    valence = (F.length("word") % 7 - 3) / F.lit(2.0)
    return news.lexicon_sentiment(items, words.withColumn("valence", valence))


def sentiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.news(spark, sf_dir)
    recent = news.news_recency(items, views.NEWS_AS_OF)
    lexicon = news.lexicon_table(spark, views.LEXICON)
    return news.sentiment_summary(items, news.lexicon_sentiment(recent, lexicon))


def order_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = (
        views.table(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("tradingsymbol"))
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_price"))
    )
    return orders.order_intents(
        quotes, quotes, views.intended_orders(spark, sf_dir), views.ORDERS_AS_OF
    )


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.order_ledger(views.order_responses(spark, sf_dir), views.REQUESTED_AT)


def holdings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.holdings_view(views.holdings(spark, sf_dir), places=2)


def market_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.market_session(views.table(spark, sf_dir, "events"))
    return rows.select("event_id", "ts", "local_ts")


def daily_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``events`` and ``customer``."""
    rules = daily.DailyRules(
        price_limit=SHORT_PRICE_LIMIT,
        correlation_threshold=SHORT_THRESHOLD,
        score=SHORT_RULES,
    )
    picked = daily.daily_selection(
        scratch_store(spark),
        views.instruments(spark, sf_dir),
        views.bars_short(spark, sf_dir),
        views.replies(spark, sf_dir),
        views.SHORT_AS_OF,
        rules,
    )
    return picked.select("Date_Update", "tradingsymbol", "score", "sector", "latest_close")


QUERIES: dict[str, Query] = {
    "universe_filter": universe_filter,
    "universe_snapshot": universe_snapshot,
    "instrument_lookup": instrument_lookup,
    "daily_bars": daily_bars,
    "daily_bars_long": daily_bars_long,
    "ingest_watermark": ingest_watermark,
    "ingest_plan": ingest_plan,
    "ingest_new_bars": ingest_new_bars,
    "ingest_new_bars_min2": ingest_new_bars_min2,
    "ingest_stream": ingest_stream_query,
    "late_bars": late_bars,
    "event_time_bars": event_time_bars_query,
    "intraday_bars": intraday_bars,
    "session_bars": session_bars,
    "universe_from_csv": universe_from_csv,
    "moving_averages": _indicator_query(ind.moving_averages, ["MA20", "MA50"]),
    "rsi14": _indicator_query(ind.rsi14, ["RSI14"]),
    "atr14": _indicator_query(ind.atr14, ["ATR14"]),
    "macd": _indicator_query(ind.macd, ["MACD", "MACD_signal"]),
    "obv": _indicator_query(ind.obv, ["OBV"]),
    "liquidity_volatility": _indicator_query(
        ind.liquidity_volatility, ["avg_daily_volume", "volatility_1m"]
    ),
    "price_changes": _indicator_query(ind.price_changes, ["price_change_1w", "price_change_1m"]),
    "indicators": indicators,
    "indicators_short": indicators_short,
    "indicators_chunked": indicators_chunked,
    "indicators_incremental": indicators_incremental,
    "latest_bar": latest_bar,
    "latest_bar_maintained": latest_bar_maintained,
    "score": score,
    "score_short": score_short,
    "scores_snapshot": scores_snapshot,
    "latest_scores": latest_scores,
    "candidates": candidates,
    "return_correlation": return_correlation,
    "return_correlation_by_date": return_correlation_by_date,
    "select_top": select_top,
    "select_top_by_date": select_top_by_date,
    "select_top_one_per_sector": select_top_one_per_sector,
    "top_picks": top_picks,
    "unclassified_symbols": unclassified_symbols,
    "sector_prompt_batches": sector_prompt_batches,
    "sector_replies": sector_replies,
    "sector_rejects": sector_rejects,
    "news_recency": news_recency,
    "news_recency_minutes": news_recency_minutes,
    "lexicon_sentiment": lexicon_sentiment,
    "lexicon_sentiment_large": lexicon_sentiment_large,
    "sentiment_summary": sentiment_summary,
    "order_intents": order_intents,
    "order_ledger": order_ledger,
    "holdings_view": holdings_view,
    "market_session": market_session,
    "daily_pipeline": daily_selection,
}
