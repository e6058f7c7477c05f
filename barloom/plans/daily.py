"""The daily batch: universe, bars, indicators, scores, sectors, picks, with tables between the stages."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.incremental import KEY, extend_indicators, maintained_latest
from barloom.operators.ingest import ingest_new_bars, ingest_plan
from barloom.operators.orders import order_intents, order_ledger
from barloom.operators.scoring import ScoreRules, latest_scores, score, scores_snapshot
from barloom.operators.sectors import (
    ALLOWED_SECTORS,
    sector_replies,
    sector_request_batches,
    unclassified_symbols,
)
from barloom.operators.selection import (
    CORRELATION_THRESHOLD,
    PRICE_LIMIT,
    TOP_N,
    candidates,
    select_top,
    top_picks,
)
from barloom.operators.universe import universe_snapshot
from barloom.session import cut_lineage, scratch_scope
from barloom.sources.store import TableStore


@dataclass(frozen=True)
class DailyRules:
    """Parameters of one daily batch; the defaults are its fixed values."""

    top_n: int = TOP_N
    price_limit: float = PRICE_LIMIT
    correlation_threshold: float = CORRELATION_THRESHOLD
    min_new_bars: int = 1
    batch_size: int = 100
    align: str = "position"
    max_per_sector: int | None = None
    score: ScoreRules = ScoreRules()


def load_bars(
    store: TableStore, bars: DataFrame, stock_list: DataFrame, as_of: date, min_new_bars: int = 1
) -> None:
    """Append the day's bars and extend the indicators by them.

    What is loaded follows from the state of the indicators, one row per symbol. It is published last, so a run that failed
    on the way is planned alike again, and neither bars nor indicators are appended twice.
    """
    if not store.exists("indicator_state") and store.exists("stock_timeseries"):
        extend_indicators(store, store.read("stock_timeseries"))
    known = store.read("indicator_state").select("tradingsymbol", F.col("max_date").alias("date"))
    fresh = cut_lineage(ingest_new_bars(bars, ingest_plan(stock_list, known, as_of), min_new_bars), "planned")
    store.append_missing("stock_timeseries", fresh, KEY)
    extend_indicators(store, fresh)


def store_scores(store: TableStore, as_of: date, rules: ScoreRules) -> DataFrame:
    """Score the maintained last bars of the universe; no history is read."""
    universe = store.read("stock_list").select("tradingsymbol").distinct()
    latest = maintained_latest(store).join(universe, "tradingsymbol", "left_semi")
    return scores_snapshot(store, score(latest, rules), as_of)


def sector_requests(store: TableStore, batch_size: int) -> DataFrame:
    """Request texts for the symbols without a sector, to be answered outside Spark."""
    new = unclassified_symbols(store.read("stock_list"), store.read("stock_sectors"))
    return sector_request_batches(new, batch_size)


def store_sectors(
    store: TableStore, replies: DataFrame, as_of: date, allowed_sectors=ALLOWED_SECTORS
) -> None:
    """Append the landed replies' sectors; symbols that already have one are not added again."""
    # of several answers for a symbol an allowed one wins
    best = F.max(F.struct("is_allowed", "sector", "name", "Date_Update")).alias("best")
    rows = (
        sector_replies(replies, as_of, allowed_sectors)
        .groupBy("tradingsymbol")
        .agg(best)
        .select("tradingsymbol", "best.*")
    )
    known = store.read("stock_sectors").select("tradingsymbol").distinct()
    store.append("stock_sectors", rows.join(known, "tradingsymbol", "left_anti"))


def day_orders(store: TableStore, quotes: DataFrame, as_of: date) -> DataFrame:
    """Intents for the day's picks that the ledger does not hold yet."""
    picks = store.read("stock_short_buy").filter(F.col("Date_Update") == F.lit(as_of))
    return order_intents(picks, quotes, store.read("stock_intended_orders"), as_of)


def store_order_responses(store: TableStore, responses: DataFrame, requested_at: datetime) -> None:
    """Append landed responses to the ledger; rows it already holds, or that landed twice, are added once."""
    known = store.read("stock_intended_orders").select("id")
    rows = order_ledger(responses, requested_at)
    store.append("stock_intended_orders", rows.join(known, "id", "left_anti"))


def daily_selection(
    store: TableStore,
    instruments: DataFrame,
    bars: DataFrame,
    replies: DataFrame | None,
    as_of: date,
    rules: DailyRules = DailyRules(),
) -> DataFrame:
    """Run the stages in order and return the day's picks from ``stock_short_buy``.

    ``bars`` are the landed daily bars and ``replies`` the landed sector replies. Stages hand over
    through stored tables, each written once, so a failed run can be repeated from the start. Scratch folders go with the run.
    """
    with scratch_scope(store.spark):
        stock_list = universe_snapshot(store, instruments, as_of)
        load_bars(store, bars, stock_list, as_of, rules.min_new_bars)
        longest = store.read("indicator_state").agg(F.max("n_rows")).first()[0] or 0
        scores = store_scores(store, as_of, rules.score)
        if replies is not None:
            store_sectors(store, replies, as_of)
        ranked = candidates(
            latest_scores(scores), store.read("stock_sectors"), stock_list, rules.price_limit
        )
        picks = select_top(
            ranked,
            store.read("stock_timeseries").select("tradingsymbol", "date", "close"),
            rules.top_n,
            rules.correlation_threshold,
            rules.align,
            rules.max_per_sector,
            longest,
        )
        store.replace_day("stock_short_buy", top_picks(ranked, picks, as_of), as_of)
    picked = store.read("stock_short_buy")
    return picked.filter(F.col("Date_Update") == F.lit(as_of))
