"""The driver's tables seen through the shapes the operators expect."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.ingest import daily_bars

SHORT_AS_OF = date(2024, 1, 30)
ORDERS_AS_OF = date(2000, 2, 21)
NEWS_AS_OF = datetime(2024, 1, 30, 12, 0, 0)
REQUESTED_AT = datetime(2024, 1, 30, 16, 30, 0)

# fixed values: a small word list for the sentiment operators
LEXICON = {
    "the": 0.5,
    "of": -0.3,
    "and": 0.4,
    "is": 1.1,
    "that": -0.7,
    "for": 0.9,
    "with": 1.3,
    "was": -1.6,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_ticks(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("tradingsymbol"),
        "ts",
        F.col("event_id").alias("tick_id"),
        F.col("value").alias("price"),
        F.lit(1).cast("bigint").alias("quantity"),
    )


def bars_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of daily bars per user, from ``events``."""
    return daily_bars(event_ticks(table(spark, sf_dir, "events")))


def bars_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven years of daily bars per supplier, from ``lineitem``."""
    ticks = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("tradingsymbol"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return daily_bars(ticks, order_by=order)


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = key.cast("string")
    exchange = F.when(key % 5 == 0, F.lit("BSE")).otherwise(F.lit("NSE"))
    symbol = F.when(
        key % 17 == 0, F.concat((key % 10).cast("string"), F.lit("X-GS"))
    ).otherwise(F.concat(F.lit("U"), text))
    return table(spark, sf_dir, "customer").select(
        key.alias("instrument_token"),
        key.alias("exchange_token"),
        symbol.alias("tradingsymbol"),
        F.when(key % 11 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.lit("EQ").alias("instrument_type"),
        F.when(key % 7 == 0, F.lit("INDICES")).otherwise(exchange).alias("segment"),
        exchange.alias("exchange"),
    )


def all_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.lit(SHORT_AS_OF).alias("Date_Update"),
        F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("tradingsymbol"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("sector"),
    )


def stock_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What earlier replies left: every third symbol has no sector yet."""
    number = F.substring("tradingsymbol", 2, 20).cast("bigint")
    return all_sectors(spark, sf_dir).filter(number % 3 != 0)


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier load left: even users up to 2024-01-20."""
    user = F.substring("tradingsymbol", 2, 20).cast("bigint")
    return bars_short(spark, sf_dir).filter(
        (user % 2 == 0) & (F.col("date") <= F.lit(date(2024, 1, 20)))
    )


def stored_bars_but_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history that lacks the last landed bar of even users and the last two of the rest."""
    bars = bars_short(spark, sf_dir)
    recent = Window.partitionBy("tradingsymbol").orderBy(F.desc("date"))
    user = F.substring("tradingsymbol", 2, 20).cast("bigint")
    ranked = bars.withColumn("_recent", F.row_number().over(recent))
    return ranked.filter(F.col("_recent") > 1 + user % 2).drop("_recent")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    count = (doc % 48).cast("string")
    newline = F.instr("text", "\n")
    title = F.when(newline > 0, F.substring_index("text", "\n", 1)).otherwise(F.col("text"))
    rest = F.when(newline > 0, F.substr(F.col("text"), newline + 1))
    age = (
        F.when(doc % 4 == 0, F.concat(F.lit(" "), count, F.lit("  hours ago")))
        .when(doc % 4 == 1, F.concat(count, F.lit("\tdays ago")))
        .when(doc % 4 == 2, F.concat(count, F.lit(" mins ago")))
        .otherwise(F.lit("an hour ago"))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("name"),
        doc.alias("item_no"),
        title.alias("title"),
        rest.alias("desc"),
        age.alias("date"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply texts holding at most 50 sector rows each, for all symbols. Some have no array, some are cut short,
    some hold two arrays, and some are quoted as no JSON is."""
    batch = F.floor(F.substring("tradingsymbol", 2, 20).cast("bigint") / F.lit(50))
    item = F.struct("tradingsymbol", "name", "sector")
    # a batch never has more than 50 rows
    array = F.to_json(F.sort_array(F.collect_list(item)))
    whole = F.concat(F.lit("Here is the list [as asked]:\n"), array, F.lit("\nDone."))
    grouped = (
        all_sectors(spark, sf_dir).groupBy(batch.alias("batch_id")).agg(array.alias("list"), whole.alias("body"))
    )
    kind = F.col("batch_id")
    reply = (
        F.when(kind % 7 == 6, F.lit("I cannot answer that."))
        .when(kind % 11 == 10, F.concat(F.expr("substr(body, 1, length(body) - 40)"), F.lit("}]")))
        .when(kind % 13 == 12, F.concat("list", F.lit(" and "), "list"))
        .when(kind % 17 == 16, F.translate("list", '"', "'"))
        .otherwise(F.col("body"))
    )
    return grouped.select("batch_id", reply.alias("reply"))


def intended_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("tradingsymbol"),
        F.col("o_orderdate").alias("requested_at"),
    )


def order_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per order, with the time of its request, and a broker's or another error's message."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    success = (
        F.when(status == "F", F.lit(True))
        .when(status == "O", F.lit(False))
        .when(key % 2 == 0, F.lit(False))
    )
    message = (
        F.when(status == "F", F.concat(F.lit("Order placed [ID] "), key.cast("string")))
        .when(status == "O", F.lit("AMO orders cannot be placed now. [code]"))
        .when(key % 4 == 0, F.lit("Insufficient funds [margin]"))
        .when(key % 4 == 2, F.lit("KeyError: ['ltp'] missing"))
        .otherwise(F.lit("[no record]"))
    )
    refused = (status == "O") | ((status != "F") & (key % 4 == 0))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("tradingsymbol"),
        key.alias("response_no"),
        success.alias("success"),
        F.when(status == "F", F.concat(F.lit("R"), key.cast("string"))).alias("order_id"),
        message.alias("message"),
        F.when(refused, F.lit("broker")).alias("error_kind"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("requested_at"),
        F.when(status == "F", (key % 3).cast("int")).alias("filled_quantity"),
        F.when((status == "F") & (key % 3 > 0), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias(
            "average_price"
        ),
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions per supplier without a ``pnl`` column."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("tradingsymbol"))
        .agg(
            F.sum("l_quantity").cast("int").alias("quantity"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("average_price"),
            F.max_by(price, order).alias("last_price"),
        )
    )


