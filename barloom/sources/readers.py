"""Readers for landed files and relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.schemas import INSTRUMENTS


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """The instrument list: CSV files with a header.

    The full file has more columns than are used, so columns are matched by name from the header and
    cast to the fixed schema; nothing is inferred from the rows. A quoted empty text is a text, a blank
    field is NULL.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False, nullValue="\0")
    return rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in INSTRUMENTS.fields])


def jdbc_options(
    url: str,
    table: str,
    split_column: str | None = None,
    lower: object = None,
    upper: object = None,
    splits: int = 1,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a JDBC scan; with ``split_column`` the scan is cut into range queries."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if split_column:
        options |= {
            "partitionColumn": split_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(splits),
        }
    return options


def read_jdbc(
    spark: SparkSession, url: str, table: str, single_task: bool = False, **split: object
) -> DataFrame:
    """A relational table as a frame; filters and projections are pushed to the database.

    Without a ``split_column`` one task reads the whole table, which has to be asked for.
    """
    if not split.get("split_column") and not single_task:
        raise ValueError("name a split_column, or ask for single_task=True")
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **split)).load()


def append_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 10_000) -> None:
    """Append ``df`` to a relational table."""
    writer = df.write.format("jdbc").mode("append")
    writer.options(url=url, dbtable=table, batchsize=str(batch_size)).save()
