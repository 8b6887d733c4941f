"""Tables by name: scans by key range, lookups, upserts, rename, drop, list, count and paging.

Tables are tables of the session's catalog, stored as Parquet, with a column
``key``.  Batches are merged by joins; a single cell or row is a batch of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_range(df: DataFrame, key: str, start=None, end=None) -> DataFrame:
    """Rows with start <= key < end; open where a bound is None.  The bounds reach the scan."""
    c = F.col(key)
    kept = df if start is None else df.where(c >= F.lit(start))
    return kept if end is None else kept.where(c < F.lit(end))


def page(df: DataFrame, key: str, start=None, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(first ``size`` rows with key >= ``start`` in order, at most one row with the next page's key)."""
    rows = key_range(df, key, start)
    head = rows.orderBy(key).limit(size + 1)
    return head.limit(size), head.offset(size).select(key)


def upsert_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``rows`` in place of those of the same key, and new ones added.

    Keys of ``rows`` are unique.  Rows with a null key are never replaced.
    """
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(*table.columns))


def upsert_cells(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Cells (key, col, value) with the updates' values where both have the cell; one shuffle for both."""
    tagged = cells.select("key", "col", F.struct(F.lit(0).alias("t"), "value").alias("x")).unionByName(
        updates.select("key", "col", F.struct(F.lit(1).alias("t"), "value").alias("x"))
    )
    return tagged.groupBy("key", "col").agg(F.max("x").alias("x")).select("key", "col", F.col("x.value").alias("value"))


class Catalog:
    """A thin facade over the session's catalog."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def put(self, name: str, rows: DataFrame, mode: str = "errorifexists") -> None:
        """Write a table: errorifexists, overwrite, append or merge (by ``key``)."""
        if mode != "merge" or not self.exists(name):
            rows.write.mode("errorifexists" if mode == "merge" else mode).saveAsTable(name)
            return
        merged = upsert_rows(self.spark.table(name), rows, "key")
        # A table cannot be overwritten while it is read: written aside, then swapped.
        aside = f"{name}__merged"
        merged.write.mode("overwrite").saveAsTable(aside)
        self.drop(name)
        self.rename(aside, name)

    def put_cells(self, name: str, cells: DataFrame) -> None:
        """Merge cells (key, col, value) into a table of cells."""
        old = self.spark.table(name) if self.exists(name) else cells.limit(0)
        aside = f"{name}__merged"
        upsert_cells(old, cells).write.mode("overwrite").saveAsTable(aside)
        self.drop(name)
        self.rename(aside, name)

    def scan(self, name: str, start=None, end=None) -> DataFrame:
        """Rows in a half-open key range; raises if there is no such table."""
        return key_range(self.spark.table(name), "key", start, end)

    def get_row(self, name: str, key) -> DataFrame:
        """The row of a key, or no row.  For many keys join instead."""
        return self.spark.table(name).where(F.col("key") == F.lit(key))

    def get(self, name: str, key, column: str):
        """One cell, or None."""
        row = self.get_row(name, key).select(column).take(1)
        return row[0][0] if row else None

    def has_row(self, name: str, key) -> bool:
        return bool(self.get_row(name, key).take(1))

    def count(self, name: str) -> int:
        """Rows of a table; 0 if there is none."""
        return self.spark.table(name).count() if self.exists(name) else 0

    def page(self, name: str, start=None, size: int = 10) -> tuple[DataFrame, DataFrame]:
        return page(self.spark.table(name), "key", start, size)

    def rename(self, old: str, new: str) -> None:
        """Rename a table; raises if ``new`` exists or ``old`` does not."""
        self.spark.sql(f"ALTER TABLE `{old}` RENAME TO `{new}`")

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
