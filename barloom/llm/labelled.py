"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import col, label_fold


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``text`` and ``label`` (0 or 1) of at most ``per_class`` documents of either label, none of fold 0.

    Which ones follows from a hash of the id, so a fit is repeatable. A document labelled twice counts with
    its larger label. The chosen labels, at most ``2 * per_class`` rows, are small enough to broadcast.
    """
    given = (
        labels.select(col(id_col).alias("id"), col(label).alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (label_fold(F.col("id")) != 0))
        .groupBy("id")
        .agg(F.max("label").cast("int").alias("label"))
    )
    chosen = [
        given.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_class)
        for value in (0, 1)
    ]
    source = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    return source.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").select("id", "text", "label")
