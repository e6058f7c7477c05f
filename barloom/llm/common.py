"""Helpers shared by the corpus operators."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import cut_lineage, scratch_path
from barloom.sources import files

__all__ = ["col", "cut_lineage", "forget", "label_fold", "numbered", "partition_offsets", "scratch_path", "table"]


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def forget(*written: DataFrame) -> None:
    """Removes the folders that ``cut_lineage`` wrote for these frames; nothing may read them any more."""
    for frame in written:
        for folder in {name.rpartition("/")[0] for name in frame.inputFiles()}:
            files.remove(frame.sparkSession, unquote(folder))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; fold 0 is held out of every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def partition_offsets(totals: DataFrame, part: str, amount: str) -> DataFrame:
    """Exclusive prefix sums of one total per partition: columns ``part`` and ``base``.

    Only one (partition, total) pair per written partition reaches the driver: their number is a property
    of the layout, not of the rows.
    """
    spark = totals.sparkSession
    base, rows = 0, []
    for row in sorted(totals.select(part, amount).collect()):
        rows.append((int(row[0]), base))
        base += int(row[1])
    return spark.createDataFrame(rows, f"{part} int, base long")


def numbered(rows: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The rows, written once, with a dense ``id`` from 1 on, and their number, at most 2^32 - 1."""
    place = F.monotonically_increasing_id()
    written = cut_lineage(rows.withColumn("_place", place), label)
    part = F.shiftright("_place", 33).cast("int")
    totals = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    totals = cut_lineage(totals, f"{label}-totals")
    number = totals.agg(F.sum("_rows")).first()[0] or 0
    if number >= 1 << 32:
        raise ValueError(f"{label}: more than 2^32 - 1 rows")
    if not number:
        return written.drop("_place").withColumn("id", F.lit(0).cast("long")), 0
    bases = F.broadcast(partition_offsets(totals, "_part", "_rows"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    found = written.withColumn("_part", part).join(bases, "_part")
    return found.withColumn("id", F.col("base") + within + 1).drop("_part", "_place", "base"), number
