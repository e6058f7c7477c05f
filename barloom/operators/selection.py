"""Candidates, return correlation and the greedy pick of uncorrelated symbols."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from barloom.functions.columns import round_half_even
from barloom.functions.series import CHUNK_ROWS, DATE, POS, SYMBOL, longest_series
from barloom.operators.indicators import daily_returns
from barloom.session import cut_lineage

# fixed values: defaults of the daily selection
TOP_N = 10
PRICE_LIMIT = 200.0
CORRELATION_THRESHOLD = 0.6

BLOCK = 64
BLOCK_MOST = 1024
#: Parts of the symbols that meet their own copy of the other series, when those are too many to broadcast.
PARTS = 64
BROADCAST_RETURNS = 1_000_000


def candidates(
    scores: DataFrame, sectors: DataFrame, stock_list: DataFrame, price_limit: float = PRICE_LIMIT
) -> DataFrame:
    """Scores with sector and name, under the price limit.

    Sector and name are reduced to one row per symbol first (the newest sector), so repeated rows in
    those tables do not multiply the scores.
    """
    sector = sectors.groupBy(SYMBOL).agg(
        F.max_by("sector", F.struct("Date_Update", "sector")).alias("sector")
    )
    name = stock_list.groupBy(SYMBOL).agg(F.min("name").alias("name"))
    return (
        scores.filter(F.col("latest_close") <= price_limit)
        .join(sector, SYMBOL, "left")
        .join(name, SYMBOL, "left")
        .select("Date_Update", SYMBOL, "name", "sector", "score", "latest_close")
    )


def _pair_correlation(pairs: DataFrame) -> DataFrame:
    """Pearson correlation per (tradingsymbol, other) from rows with both returns ``x`` and ``y``.

    Deviations are taken over the rows of the pair. The quotient is guarded because a constant series
    has deviation 0; its correlation, like that of a single common row, is NULL.
    """
    spread = F.stddev_samp("x") * F.stddev_samp("y")
    return pairs.groupBy(SYMBOL, "other").agg(
        F.count(F.lit(1)).alias("n_common"),
        F.try_divide(F.covar_samp("x", "y"), spread).alias("correlation"),
    )


def return_correlation(
    returns: DataFrame,
    others: DataFrame,
    align: str = "position",
    other_rows: int | None = None,
) -> DataFrame:
    """Correlation of every series in ``returns`` with each series in ``others``.

    ``others`` are the few series compared against (the accepted symbols), so the work grows with
    ``returns``, not with its square. Rows are aligned by position in the series or by date. With at most
    ``BROADCAST_RETURNS`` rows (``other_rows``, counted when not given) ``others`` is broadcast and
    ``returns`` is only shuffled as one partial aggregate per pair and task. Beyond that the symbols are
    split into ``PARTS`` and each part has a copy of ``others``, so that a position that all series have is
    spread over as many tasks.
    """
    key = {"position": POS, "date": DATE}[align]
    right = others.select(
        F.col(key), F.col(SYMBOL).alias("other"), F.col("daily_return").alias("y")
    )
    other_rows = others.count() if other_rows is None else other_rows
    left = returns.select(key, SYMBOL, F.col("daily_return").alias("x"))
    if other_rows <= BROADCAST_RETURNS:
        pairs = left.join(F.broadcast(right), key)
    else:
        left = left.withColumn("_part", F.pmod(F.xxhash64(SYMBOL), F.lit(PARTS)))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))
        pairs = left.join(right.withColumn("_part", copies), [key, "_part"])
    return _pair_correlation(pairs.filter(F.col(SYMBOL) != F.col("other")))


def _rank_order() -> list[Column]:
    return [F.desc_nulls_last("score"), F.asc(SYMBOL)]


def _after(row: Row) -> Column:
    """True for candidates ranked after ``row``."""
    score, later_name = F.col("score"), F.col(SYMBOL) > row[SYMBOL]
    if row["score"] is None:
        return score.isNull() & later_name
    return score.isNull() | (score < row["score"]) | ((score == row["score"]) & later_name)


def _block_conflicts(
    returns: DataFrame, ranked: Sequence[str], align: str, threshold: float
) -> DataFrame:
    """Per symbol of one block, the earlier symbols of the block it is too correlated with.

    A block holds at most ``BLOCK`` symbols, so a position or date meets at most that many rows.
    """
    key = {"position": POS, "date": DATE}[align]
    order = F.array(*[F.lit(s) for s in ranked])
    rows = returns.filter(F.col(SYMBOL).isin(*ranked)).select(
        key,
        SYMBOL,
        F.col("daily_return").alias("x"),
        F.array_position(order, F.col(SYMBOL)).alias("rank"),
    )
    earlier = rows.select(
        key,
        F.col(SYMBOL).alias("other"),
        F.col("x").alias("y"),
        F.col("rank").alias("other_rank"),
    )
    pairs = rows.join(earlier, key).filter(F.col("other_rank") < F.col("rank"))
    too_close = _pair_correlation(pairs).filter(F.abs("correlation") >= threshold)
    return too_close.groupBy(SYMBOL).agg(F.collect_list("other").alias("conflicts"))


def _accept_in_order(
    block: Sequence[Row],
    conflicts: DataFrame,
    accepted: Sequence[Row],
    top_n: int,
    max_per_sector: int | None,
) -> list[Row]:
    """Walk one block in rank order; returns the accepted (tradingsymbol, sector) rows, old ones first.

    The walk starts with the rows accepted earlier, which conflict with nothing in the block any more.
    """
    spark = conflicts.sparkSession
    schema = "rank int, tradingsymbol string, sector string"
    entries = [*accepted, *block]
    numbered = [(i, row[SYMBOL], row["sector"]) for i, row in enumerate(entries)]
    walk = (
        spark.createDataFrame(numbered, schema)
        .join(conflicts, SYMBOL, "left")
        .select(
            F.struct(
                "rank",
                SYMBOL,
                "sector",
                F.coalesce("conflicts", F.array().cast("array<string>")).alias("conflicts"),
            ).alias("entry")
        )
        .agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    )
    start = F.array().cast("array<struct<tradingsymbol:string,sector:string>>")

    def step(taken: Column, entry: Column) -> Column:
        fits = (F.size(taken) < top_n) & ~F.arrays_overlap(
            F.transform(taken, lambda t: t[SYMBOL]), entry["conflicts"]
        )
        if max_per_sector is not None:
            same = F.filter(taken, lambda t: t["sector"].eqNullSafe(entry["sector"]))
            fits = fits & (F.size(same) < max_per_sector)
        new = F.array(F.struct(entry[SYMBOL].alias(SYMBOL), entry["sector"].alias("sector")))
        return F.when(fits, F.concat(taken, new)).otherwise(taken)

    return walk.select(F.aggregate("entries", start, step).alias("taken")).first()["taken"]


def select_top(
    ranked: DataFrame,
    bars: DataFrame,
    top_n: int = TOP_N,
    correlation_threshold: float = CORRELATION_THRESHOLD,
    align: str = "position",
    max_per_sector: int | None = None,
    longest: int | None = None,
    block: int = BLOCK,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The ``top_n`` best candidates no two of which are too correlated: (pick_no, tradingsymbol).

    A candidate is taken unless its absolute correlation with an already taken, higher ranked one
    reaches the threshold; symbols without bars are skipped. The best ``block`` candidates are decided
    first: their bars are read by symbol and only pairs inside the block are formed. If that leaves
    the pick short, one pass removes every remaining candidate that conflicts with a taken one
    (work proportional to the candidates) and the next block, four times as large, follows. Each round
    takes at least one symbol, so there are at most ``top_n`` rounds. Returns are derived once and stored.
    """
    spark = ranked.sparkSession
    longest = longest_series(bars) if longest is None else longest
    with_series = bars.select(SYMBOL).distinct()
    pool = (
        ranked.groupBy(SYMBOL)
        .agg(F.max(F.struct("score", "sector")).alias("best"))
        .select(SYMBOL, "best.*")
        .join(with_series, SYMBOL, "left_semi")
    )
    pool = cut_lineage(pool, "ranked")
    returns = cut_lineage(
        daily_returns(bars, longest, chunk_rows).select(SYMBOL, POS, DATE, "daily_return"), "returns"
    )
    taken: list[Row] = []
    while len(taken) < top_n:
        head = pool.orderBy(*_rank_order()).limit(block).collect()
        if not head:
            break
        conflicts = _block_conflicts(
            returns, [row[SYMBOL] for row in head], align, correlation_threshold
        )
        before = len(taken)
        taken = _accept_in_order(head, conflicts, taken, top_n, max_per_sector)
        if len(taken) >= top_n or len(head) < block:
            break  # all candidates have been seen
        new = [row[SYMBOL] for row in taken[before:]]
        block = min(4 * block, BLOCK_MOST)
        pool = pool.filter(_after(head[-1]))
        if max_per_sector is not None:
            pool = _without_full_sectors(pool, taken, max_per_sector)
        against = return_correlation(
            returns.join(pool.select(SYMBOL), SYMBOL, "left_semi"),
            returns.filter(F.col(SYMBOL).isin(*new)),
            align,
            other_rows=len(new) * longest,
        )
        too_close = against.filter(F.abs("correlation") >= correlation_threshold)
        pool = cut_lineage(
            pool.join(too_close.select(SYMBOL).distinct(), SYMBOL, "left_anti"), "ranked"
        )
    rows = [(i + 1, row[SYMBOL]) for i, row in enumerate(taken)]
    return spark.createDataFrame(rows, "pick_no int, tradingsymbol string")


def _without_full_sectors(pool: DataFrame, taken: Sequence[Row], limit: int) -> DataFrame:
    sectors = [row["sector"] for row in taken]
    for sector in {s for s in sectors if sectors.count(s) >= limit}:
        pool = pool.filter(~F.col("sector").eqNullSafe(F.lit(sector)))
    return pool


def top_picks(ranked: DataFrame, picks: DataFrame, as_of: date) -> DataFrame:
    """The candidates that were picked, in the form they are stored and returned."""
    return ranked.join(picks, SYMBOL, "left_semi").select(
        F.lit(as_of).alias("Date_Update"),
        SYMBOL,
        round_half_even("score").alias("score"),
        "sector",
        round_half_even("latest_close").alias("latest_close"),
    )
