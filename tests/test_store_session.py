"""Stored tables, the shared scratch folder, and the whole daily batch."""

import datetime as dt

import numpy as np
import pytest
from frames import bar_rows, bars_frame
from pyspark.sql import functions as F

from barloom.operators.scoring import ScoreRules
from barloom.plans import daily
from barloom.schemas import INSTRUMENTS, STOCK_LIST, STOCK_TIMESERIES
from barloom.session import cut_lineage, scratch_path, scratch_scope

AS_OF = dt.date(2024, 3, 31)


def test_scratch_is_in_the_configured_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(root)


def scratch_folders(spark):
    from barloom.sources import files

    return {name for name, _ in files.children(spark, spark.conf.get("spark.checkpoint.dir"))}


def test_scratch_goes_with_its_scope(spark):
    outer = cut_lineage(spark.range(3), "outer")
    before = scratch_folders(spark)
    with scratch_scope(spark):
        kept = cut_lineage(spark.range(2), "first")
        with scratch_scope(spark):
            assert cut_lineage(spark.range(5), "second").count() == 5
        assert not any(name.startswith("second-") for name in scratch_folders(spark))
        assert kept.count() == 2
    assert scratch_folders(spark) == before and outer.count() == 3
    with pytest.raises(ValueError), scratch_scope(spark):
        cut_lineage(spark.range(2), "third")
        raise ValueError
    assert scratch_folders(spark) == before
    scratch_path(spark, "never-written")


def test_cut_lineage_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "array(id) as a", "cast(null as double) as d")
    cut = cut_lineage(df)
    assert cut.schema.simpleString() == df.schema.simpleString()
    assert sorted(cut.collect()) == sorted(df.collect())
    assert "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_missing_table_reads_as_empty(store):
    assert not store.exists("stock_sectors")
    assert store.read("stock_sectors").count() == 0


def listed(spark, *symbols):
    rows = [(None, i, i, name, name, "EQ", "NSE", "NSE") for i, name in enumerate(symbols)]
    return spark.createDataFrame(rows, STOCK_LIST)


def broken(df):
    """Fails while it is written, after some of its rows are out."""
    return df.withColumn("name", F.when(F.col("tradingsymbol") == "C", F.raise_error(F.lit("cut"))).otherwise("x"))


def names(df):
    return sorted(r["tradingsymbol"] for r in df.collect())


def test_a_failed_replace_leaves_the_old_rows(spark, store):
    with pytest.raises(Exception, match="cut"):
        store.replace("stock_list", broken(listed(spark, "C")))
    assert names(store.read("stock_list")) == []
    store.replace("stock_list", listed(spark, "A", "B"))
    with pytest.raises(Exception, match="cut"):
        store.replace("stock_list", broken(listed(spark, "B", "C").repartition(2)))
    assert names(store.read("stock_list")) == ["A", "B"]


def test_readers_keep_their_version_and_old_ones_go(spark, store):
    store.replace("stock_list", listed(spark, "A", "B"))
    early = store.read("stock_list")
    store.replace("stock_list", store.read("stock_list").filter("tradingsymbol = 'A'"))  # from itself
    assert names(early) == ["A", "B"] and names(store.read("stock_list")) == ["A"]
    store.append("stock_list", listed(spark, "D"))
    assert names(store.read("stock_list")) == ["A", "D"]
    for name in "EFG":
        store.replace("stock_list", listed(spark, name))
    assert names(store.read("stock_list")) == ["G"] and len(store.versions("stock_list")) == 2


def test_a_day_is_replaced_by_finished_rows_only(spark, store):
    def scores(*rows):
        return spark.createDataFrame(rows, "tradingsymbol string, score double, latest_close double")

    day, other = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    store.replace_day("stock_scores", scores(("A", 1.0, 1.0), ("B", 1.0, 1.0)), day)
    store.replace_day("stock_scores", scores(("A", 3.0, 1.0)), other)
    failing = scores(("C", 1.0, 1.0)).withColumn("score", F.raise_error(F.lit("cut")).cast("double"))
    with pytest.raises(Exception, match="cut"):
        store.replace_day("stock_scores", failing, day)
    assert names(store.read("stock_scores")) == ["A", "A", "B"]
    store.replace_day("stock_scores", scores(("B", 2.0, 1.0)), day)
    assert names(store.read("stock_scores")) == ["A", "B"]
    store.replace_day("stock_scores", scores(("Z", 1.0, 1.0)).limit(0), day)
    assert [(r["tradingsymbol"], r["Date_Update"]) for r in store.read("stock_scores").collect()] == [("A", other)]


def test_bars_are_read_by_month(spark, store):
    store.append("stock_timeseries", bars_frame(spark, bar_rows("A", [1.0] * 100)))
    assert store.read("stock_timeseries").columns == STOCK_TIMESERIES.fieldNames()
    part = store.read("stock_timeseries", dt.date(2024, 2, 20), dt.date(2024, 3, 5))
    assert part.count() == 15
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-02-01" in plan and "2024-03-01" in plan
    files = {r[0].split("month=")[1][:7] for r in part.select(F.input_file_name()).distinct().collect()}
    assert files == {"2024-02", "2024-03"}


def instruments(spark, n):
    rows = [(i, i, f"S{i:02d}", f"Name {i}", "EQ", "NSE", "NSE") for i in range(n)]
    return spark.createDataFrame(rows, INSTRUMENTS)


def landed(spark, n, days):
    rows = []
    for i in range(n):
        closes = 50 + np.random.default_rng(i).normal(0, 1, days).cumsum()
        rows.append(bar_rows(f"S{i:02d}", np.round(np.maximum(closes, 1), 2)))
    return bars_frame(spark, *rows)


@pytest.mark.parametrize("sector_limit", [None, 2])
def test_daily_batch_can_be_repeated(spark, store, sector_limit):
    items = ",".join(
        f'{{"tradingsymbol":"S{i:02d}","name":"n","sector":"{"Metals" if i % 2 else "Paper"}"}}'
        for i in range(20)
    )
    replies = spark.createDataFrame([(f"[{items}]",)], "reply string")
    rules = daily.DailyRules(
        top_n=5,
        correlation_threshold=0.4,
        max_per_sector=sector_limit,
        score=ScoreRules(liquidity_scale=200.0),
    )

    def run():
        return daily.daily_selection(
            store, instruments(spark, 20), landed(spark, 22, 91), replies, AS_OF, rules
        ).collect()

    before = scratch_folders(spark)
    first, second = run(), run()
    assert scratch_folders(spark) == before
    assert sorted(first) == sorted(second)
    assert len(first) == (4 if sector_limit else 5)
    assert store.read("stock_timeseries").count() == 20 * 91
    assert store.read("stock_indicators").count() == 20 * 91
    assert store.read("stock_scores").count() == 20
    assert store.read("stock_sectors").count() == 20
    assert daily.sector_requests(store, 100).count() == 0

    quotes = landed(spark, 22, 1).selectExpr("tradingsymbol", "close as last_price")
    intents = daily.day_orders(store, quotes, AS_OF)
    assert intents.count() == len(first)
    answered = intents.limit(1).selectExpr(
        "tradingsymbol", "true as success", "'1' as order_id", "'placed' as message"
    )
    answered = cut_lineage(answered)
    at = dt.datetime(2024, 3, 31, 16)
    for _ in range(2):
        daily.store_order_responses(store, answered, at)
    assert store.read("stock_intended_orders").count() == 1
    assert daily.day_orders(store, quotes, AS_OF).count() == len(first) - 1


def test_sector_requests_before_any_reply(spark, store):
    from barloom.operators.universe import universe_snapshot

    universe_snapshot(store, instruments(spark, 250), AS_OF)
    batches = daily.sector_requests(store, 100).collect()
    assert sorted(r["n_symbols"] for r in batches) == [50, 100, 100]
