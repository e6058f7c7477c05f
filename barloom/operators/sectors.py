"""Sector labelling: which symbols need a label, request texts, and parsing of the replies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import text_bucket
from barloom.schemas import SECTOR_REPLY_ITEMS, STOCK_SECTORS

# fixed values: the sectors a label may name
ALLOWED_SECTORS = [
    "Agriculture", "Automobile", "Carbon Products", "Cement", "Ceramics", "Chemicals",
    "Construction", "Consumer Products", "Defense", "Diversified", "Education", "Electricals",
    "Energy", "Entertainment", "Environmental Services", "Financial Services", "Food & Beverage",
    "Healthcare", "Hospitality", "Industrial Equipment", "Jewelry", "Logistics", "Manufacturing",
    "Metals", "Paper", "Plastics", "Real Estate", "Retail", "Rubber", "Shipping", "Technology",
    "Telecommunications", "Textiles", "Trading",
]

# fixed value: the array of objects inside a reply, first bracket to last, across lines
REPLY_ARRAY = r"(?s)(\[\s*\{.*\}\s*\])"

REQUEST_HEAD = (
    "Give every stock below exactly one sector out of this list: {sectors}.\n"
    "Answer with a JSON array of objects having the fields tradingsymbol, name and sector.\n"
)


def unclassified_symbols(stock_list: DataFrame, sectors: DataFrame) -> DataFrame:
    """Symbols of the universe that have no sector row yet."""
    known = sectors.select("tradingsymbol").distinct()
    return stock_list.join(known, "tradingsymbol", "left_anti")


def sector_request_batches(
    unclassified: DataFrame,
    batch_size: int = 100,
    allowed_sectors: Sequence[str] = ALLOWED_SECTORS,
    rows_per_bucket: int = 10_000,
) -> DataFrame:
    """Request texts for groups of at most ``batch_size`` symbols.

    Which symbols share a request carries no meaning, so rows are first spread over buckets by a
    digest and numbered inside their bucket; the number of buckets follows the number of rows.
    """
    rows = unclassified.agg(F.count(F.lit(1))).scalar()
    buckets = F.greatest(F.lit(1), F.ceil(rows / F.lit(float(rows_per_bucket)))).cast("bigint")
    spread = F.concat_ws(":", "tradingsymbol", F.col("instrument_token").cast("string"))
    in_bucket = Window.partitionBy("bucket").orderBy("tradingsymbol", "instrument_token")
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("tradingsymbol"))
    lines = unclassified.select(
        text_bucket(spread, buckets).alias("bucket"),
        "tradingsymbol",
        "instrument_token",
        F.concat_ws(" - ", "tradingsymbol", label).alias("line"),
    )
    numbered = lines.withColumn(
        "batch_no", F.floor((F.row_number().over(in_bucket) - 1) / F.lit(batch_size))
    )
    ordered = F.sort_array(F.collect_list(F.struct("tradingsymbol", "instrument_token", "line")))
    head = REQUEST_HEAD.format(sectors=", ".join(allowed_sectors))
    return (
        numbered.groupBy("bucket", "batch_no")
        .agg(F.count(F.lit(1)).alias("n_symbols"), ordered.alias("_lines"))
        .select(
            "bucket",
            "batch_no",
            "n_symbols",
            F.concat(F.lit(head), F.array_join("_lines.line", "\n")).alias("request"),
        )
    )


def parse_replies(replies: DataFrame) -> DataFrame:
    """Replies with the parsed items; NULL items unless the span from the first array of objects to the last
    bracket is one valid JSON array. Two arrays with text between them are therefore no array."""
    span = F.regexp_extract("reply", REPLY_ARRAY, 1)
    whole = T.StructType([T.StructField("v", SECTOR_REPLY_ITEMS)])
    wrapped = F.concat(F.lit('{"v": '), span, F.lit("}"))
    parsed = F.from_json(wrapped, whole, {"allowSingleQuotes": "false"})
    return replies.withColumn("items", F.when(span != "", parsed["v"]))


def sector_replies(
    replies: DataFrame, as_of: date, allowed_sectors: Sequence[str] = ALLOWED_SECTORS
) -> DataFrame:
    """Sector rows of all usable replies, flagged when the sector is not one of the allowed ones."""
    items = parse_replies(replies).select(F.inline("items"))
    allowed = F.coalesce(F.col("sector").isin(*allowed_sectors), F.lit(False))
    rows = items.withColumns({"Date_Update": F.lit(as_of), "is_allowed": allowed})
    return rows.select(*STOCK_SECTORS.fieldNames())


def rejected_replies(replies: DataFrame) -> DataFrame:
    """Replies that gave no rows because nothing in them could be parsed."""
    return parse_replies(replies).filter(F.col("items").isNull()).drop("items")
