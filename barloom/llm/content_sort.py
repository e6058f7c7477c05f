"""Exact duplicates by sorting contents: equal texts become neighbours and are compared in full."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import col, cut_lineage

#: Leading bytes by which the sampled splitters deal out rows; the sort itself compares whole texts.
HEAD_BYTES = 32
#: A content with more than 1 / SLICES of an average partition's rows is sorted in several slots.
SLICES = 4


def content_sort_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "largest",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: the columns of ``carry`` in a struct ``row``, and ``id``, ``keep_id``,
    ``group_size``, ``kept`` and ``text_sha256``.

    Rows are range-partitioned by splitters that Spark samples from (leading bytes, hash), sorted on disk if
    need be by the whole normalised bytes, and each row is compared in full with its neighbour: a run of
    equal neighbours is one group. The hash only orders texts with the same beginning; it decides nothing.

    A content that fills more than a quarter of an average partition is cut by id into slots, which are
    sorted apart. The first row of each run then stands for its slot in a second sort of full texts. There
    are at most ``2 * SLICES`` such slots per partition, which is what bounds the broadcast.

    A null text counts as empty. Of equal texts the row with the largest (or smallest) id stays; among
    rows that also share the id exactly one stays. Null ids lose to all others. An empty table gives no rows.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    pick, best_first = (F.max, F.desc_nulls_last) if keep == "largest" else (F.min, F.asc_nulls_last)
    text = normalise(col(text_col)) if normalise else col(text_col)
    apart = normalise is None and text_col in carry  # then the sorted text itself is carried, once
    carried = [
        (col(name).isNull() if apart and name == text_col else col(name)).alias(name) for name in carry
    ] or [F.lit(True).alias("none")]
    base = docs.select(
        F.struct(*carried).alias("row"), col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text")
    )
    base = base.withColumn("fp", F.xxhash64("text"))
    hot = _hot_contents(base, docs.count())
    keyed = (
        base.join(F.broadcast(hot), "fp", "left")
        .withColumn("slot", F.coalesce(F.pmod(F.xxhash64("id"), F.col("slots")), F.lit(0)))
        .withColumn("head", F.substring(F.col("text").cast("binary"), 1, HEAD_BYTES))
    )
    dealt = keyed.repartitionByRange("head", "fp", "slot")
    by_content = Window.partitionBy("head", "fp", "slot").orderBy("text", "id")
    starts = F.when(F.lag("text").over(by_content) == F.col("text"), 0).otherwise(1)
    sorted_rows = (
        dealt.withColumn("starts", starts)
        .withColumn("run", F.sum("starts").over(by_content))
        .select(
            *(["text"] if apart else []),
            "row", "id", "head", "fp", "slot", "run",
            F.sha2("text", 256).alias("text_sha256"),
            F.when((F.col("starts") == 1) & F.col("slots").isNotNull(), F.col("text")).alias("slot_text"),
        )
    )
    run = Window.partitionBy("head", "fp", "slot", "run")
    runs = cut_lineage(
        sorted_rows.select(
            "*",
            pick("id").over(run).alias("run_keep"),
            F.count(F.lit(1)).over(run).alias("run_size"),
            F.row_number().over(run.orderBy(best_first("id"))).alias("place"),
        ),
        "content-runs",
    )
    merged = _merge_slots(runs, pick)
    whole = runs.join(F.broadcast(merged), ["head", "fp", "slot", "run"], "left").withColumn(
        "keep_id", F.when(F.col("slot_size").isNull(), F.col("run_keep")).otherwise(F.col("slot_keep"))
    )
    row = F.col("row")
    if apart:
        own = F.when(~F.col("row").getField(text_col), F.col("text"))
        row = F.struct(*[(own if c == text_col else row.getField(c)).alias(c) for c in carry])
    return whole.select(
        row.alias("row"),
        "id",
        "keep_id",
        F.coalesce("slot_size", "run_size").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def _hot_contents(base: DataFrame, total: int) -> DataFrame:
    """Hashes with more than their share of rows and the slots they need: at most SLICES per partition."""
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1.0, total / (SLICES * parts))
    counts = base.groupBy("fp").count()
    return counts.filter(F.col("count") > share).select(
        "fp", F.ceil(F.col("count") / F.lit(share)).cast("long").alias("slots")
    )


def _merge_slots(runs: DataFrame, pick: Callable[[Column], Column]) -> DataFrame:
    """The groups of hot contents across their slots, by full comparison of one row per slot and run."""
    stand = runs.filter(F.col("slot_text").isNotNull())
    by_content = Window.partitionBy("head", "fp").orderBy("slot_text", "slot")
    starts = F.when(F.lag("slot_text").over(by_content) == F.col("slot_text"), 0).otherwise(1)
    grouped = (
        stand.withColumn("starts", starts)
        .withColumn("content", F.sum("starts").over(by_content))
        .drop("slot_text")
    )
    group = Window.partitionBy("head", "fp", "content")
    return grouped.select(
        "head", "fp", "slot", "run",
        pick("run_keep").over(group).alias("slot_keep"),
        F.sum("run_size").over(group).alias("slot_size"),
    )
