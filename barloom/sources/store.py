"""Stored tables: catalog tables with explicit schemas and re-runnable writes.

* A table without partitions is a folder per **version**. ``replace`` writes the new rows beside the old ones and then moves
  the table's location, which is one change in the catalog: a write that fails leaves the old rows, and whoever
  has read the old version goes on reading it. The version before the current one is kept, older ones are removed.
* A table partitioned by day has versions of each day: ``replace_day`` moves the location of the day's partition.
* ``append`` becomes visible with the commit of its job.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schemas import DERIVED, TABLES
from barloom.sources import files

VERSION = "version-"
KEPT_VERSIONS = 1


class TableStore:
    """The library's tables in one catalog database (Parquet, partitioned by day or month where written so)."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark = spark
        self.database = database
        clause = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{clause}")
        self.location = spark.catalog.getDatabase(database).locationUri.rstrip("/")

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{table}")

    def _new_version(self, table: str) -> str:
        return f"{self.location}/{table}/{VERSION}{uuid.uuid4().hex}"

    def create(self, table: str, path: str | None = None) -> None:
        if self.exists(table):
            return
        schema, partitions = TABLES[table]
        columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]
        columns += [f"`{name}` {kind}" for name, (kind, _) in DERIVED.get(table, {}).items()]
        by = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in partitions)})" if partitions else ""
        place = "" if partitions else f" LOCATION '{path or self._new_version(table)}'"
        self.spark.sql(f"CREATE TABLE {self._name(table)} ({', '.join(columns)}) USING parquet{by}{place}")

    def read(self, table: str, since: date | None = None, until: date | None = None) -> DataFrame:
        """The table, or an empty frame of its schema when nothing has been stored yet.

        ``since`` and ``until`` are inclusive bounds of ``date``; on a table laid out by month they leave the folders of
        other months unread.
        """
        if not self.exists(table):
            return self.spark.createDataFrame([], TABLES[table][0])
        # another session, such as a stream's, may have written since the files were last listed
        self.spark.catalog.refreshTable(f"{self.database}.{table}")
        rows = self.spark.read.table(f"{self.database}.{table}")
        for bound, keeps in ((since, Column.__ge__), (until, Column.__le__)):
            if bound is not None:
                rows = rows.filter(keeps(F.col("date"), F.lit(bound)))
                if "month" in DERIVED.get(table, {}):
                    rows = rows.filter(keeps(F.col("month"), F.lit(bound.replace(day=1))))
        return rows.drop(*DERIVED.get(table, {}))

    def _rows(self, table: str, df: DataFrame, gather: bool = True) -> DataFrame:
        schema, partitions = TABLES[table]
        df = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
        df = df.withColumns({name: F.expr(sql) for name, (_, sql) in DERIVED.get(table, {}).items()})
        # group a day's rows into few files; AQE splits days that are too large for one task
        return df.hint("rebalance", *partitions) if partitions and gather else df

    def append(self, table: str, df: DataFrame, gather: bool = True) -> None:
        """Append rows, those of a partition gathered into few files.

        Without ``gather`` they are not shuffled for that, and each task writes a file per partition: for loads whose every
        task has many rows of every partition.
        """
        self.create(table)
        self._rows(table, df, gather).write.mode("append").insertInto(f"{self.database}.{table}")

    def append_missing(
        self, table: str, df: DataFrame, key: list[str], dates: DataFrame | None = None, gather: bool = True
    ) -> None:
        """Append the rows of ``df`` whose ``key``, with ``date`` in it, is not there; only their months are read.

        ``df`` should be stored rows, for it is read twice, or ``dates`` stored rows with the same dates. Where the table
        has nothing between these dates, the rows are appended without a join.
        """
        since, until = (df if dates is None else dates).agg(F.min("date"), F.max("date")).first()
        if since is not None:
            known = self.read(table, since, until).select(*key)
            missing = df if known.isEmpty() else df.join(known, key, "left_anti")
            self.append(table, missing, gather)

    def replace(self, table: str, df: DataFrame) -> None:
        """Publish ``df`` as the new version of a table without partitions; it may have been read from the old one."""
        if TABLES[table][1]:
            raise ValueError(f"{table} is replaced by day")
        path = self._new_version(table)
        self._rows(table, df).write.parquet(path)
        if self.exists(table):
            self.spark.sql(f"ALTER TABLE {self._name(table)} SET LOCATION '{path}'")
            self.spark.catalog.refreshTable(f"{self.database}.{table}")
        else:
            self.create(table, path)
        self._retire(table, path.rpartition("/")[2])

    def versions(self, table: str) -> list[str]:
        """Folders of a table's versions, oldest first."""
        return self._versions(table, VERSION)

    def _versions(self, table: str, prefix: str) -> list[str]:
        found = files.children(self.spark, f"{self.location}/{table}")
        return [name for name, _ in found if name.startswith(prefix)]

    def _retire(self, table: str, current: str, prefix: str = VERSION) -> None:
        older = [name for name in self._versions(table, prefix) if name != current]
        for name in older[: len(older) - KEPT_VERSIONS]:
            files.remove(self.spark, f"{self.location}/{table}/{name}")

    def replace_day(self, table: str, df: DataFrame, day: date) -> None:
        """Publish ``df`` as the new version of one day's partition, so that a second run on a day changes nothing."""
        self.create(table)
        (partition,) = TABLES[table][1]
        rows = self._rows(table, df.withColumn(partition, F.lit(day))).drop(partition)
        prefix = f".day-{day.isoformat()}-"  # a hidden name, for the table's folder is also where its partitions are
        path = f"{self.location}/{table}/{prefix}{uuid.uuid4().hex}"
        rows.write.parquet(path)
        spec = f"PARTITION (`{partition}` = DATE '{day.isoformat()}')"
        known = not self.spark.sql(f"SHOW PARTITIONS {self._name(table)} {spec}").isEmpty()
        change = f"{spec} SET LOCATION" if known else f"ADD {spec} LOCATION"
        self.spark.sql(f"ALTER TABLE {self._name(table)} {change} '{path}'")
        self.spark.catalog.refreshTable(f"{self.database}.{table}")
        self._retire(table, path.rpartition("/")[2], prefix)
