"""Component score of the latest bar and the stored score snapshots."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import round_half_even
from barloom.sources.store import TableStore


@dataclass(frozen=True)
class ScoreRules:
    """Fixed values of the score; the bands are parameters because they depend on the market."""

    liquidity_scale: float = 1_000_000.0
    volatility_low: float = 0.02
    volatility_high: float = 0.08
    rsi_low: float = 40.0
    rsi_high: float = 60.0


COMPONENTS = [
    "pts_liquidity",
    "pts_volatility",
    "pts_change_1w",
    "pts_change_1m",
    "pts_trend",
    "pts_rsi",
    "pts_macd",
    "pts_obv",
]


def _points(condition: Column, points: float) -> Column:
    """``points`` when the condition holds; 0 when it does not or is unknown."""
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def _gain(change: str) -> Column:
    """Half a point per percent of gain; unknown stays unknown (``greatest`` would skip NULL)."""
    value = F.col(change)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)) * 50.0)


def score(latest: DataFrame, rules: ScoreRules = ScoreRules()) -> DataFrame:
    """Score components and their sum per latest bar; NULL volume mean or changes give a NULL score."""
    liquidity = F.col("avg_daily_volume") / F.lit(rules.liquidity_scale)
    parts = {
        "pts_liquidity": F.when(liquidity.isNotNull(), F.least(liquidity, F.lit(1.0)) * 10.0),
        "pts_volatility": _points(
            F.col("volatility_1m").between(rules.volatility_low, rules.volatility_high), 10.0
        ),
        "pts_change_1w": _gain("price_change_1w"),
        "pts_change_1m": _gain("price_change_1m"),
        "pts_trend": _points(F.col("MA20") > F.col("MA50"), 10.0),
        "pts_rsi": _points(F.col("RSI14").between(rules.rsi_low, rules.rsi_high), 5.0),
        "pts_macd": _points(F.col("MACD") > F.col("MACD_signal"), 5.0),
        "pts_obv": _points(F.col("OBV") > F.col("previous_OBV"), 5.0),
    }
    total = sum((F.col(name) for name in COMPONENTS[1:]), F.col(COMPONENTS[0]))
    scored = latest.withColumns(parts).withColumn("score", total)
    return scored.select("tradingsymbol", "date", "close", *COMPONENTS, "score")


def score_rows(scored: DataFrame, as_of: date) -> DataFrame:
    """Scores in the stored form: two decimals, stamped with the day."""
    return scored.select(
        F.lit(as_of).alias("Date_Update"),
        "tradingsymbol",
        round_half_even("score").alias("score"),
        round_half_even("close").alias("latest_close"),
    )


def scores_snapshot(store: TableStore, scored: DataFrame, as_of: date) -> DataFrame:
    """Store the day's scores, replacing an earlier run of the same day; returns the stored table."""
    store.replace_day("stock_scores", score_rows(scored, as_of), as_of)
    return store.read("stock_scores")


def latest_scores(scores: DataFrame) -> DataFrame:
    """Rows of the newest day; the scalar subquery prunes partitions before the scan."""
    newest = scores.agg(F.max("Date_Update").alias("newest")).scalar()
    return scores.filter(F.col("Date_Update") == newest)
