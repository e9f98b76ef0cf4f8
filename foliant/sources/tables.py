"""Tables that changes land in: Parquet in folders by a hash of the key, of which a change rewrites only those it touches.

A change reads the touched folders alone (partition pruning), makes their new rows, and puts them in place by dynamic
partition overwrite. What is to be written stands in a table of its own first, so that nothing is read while it is being
replaced, and a job that is run again after a failure replaces the same folders with the same rows. Folders that are left
without rows are deleted. The number of touched folders, which is all that the driver gets, is at most that of the
table's folders. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.writes import patch
from foliant.session import new_folder

#: The column that folders are named by.
SHARD = "shard"


@dataclass(frozen=True)
class Table:
    """`schema` is that of the rows as they are seen, without the folder's number."""

    spark: SparkSession
    folder: str
    key: str
    shards: int
    schema: str

    def shard(self, key: str | None = None):
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.shards)).cast("int")

    def stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {SHARD} int").option("basePath", self.folder).parquet(self.folder)

    def rows(self) -> DataFrame:
        return self.stored().drop(SHARD)

    def delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def changed(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Applies a change of rows to rows to the folders that `keys` (a column named like the key) fall into.

        Rows that the change leaves alone, or adds, have to have keys of these folders. Returns the folders' numbers.
        """
        touched = sorted(r[0] for r in keys.select(self.shard().alias(SHARD)).distinct().collect())
        if not touched:
            return []
        before = self.stored().where(F.col(SHARD).isin(touched)).drop(SHARD)
        staged = new_folder(self.spark, "staged")
        after = change(before).select(*before.columns, self.shard().alias(SHARD))
        after.write.parquet(staged)
        ready = self.spark.read.schema(f"{self.schema}, {SHARD} int").parquet(staged)
        held = {r[0] for r in ready.select(SHARD).distinct().collect()}
        if stray := held - set(touched):
            self.delete(staged)
            raise ValueError(f"rows of {len(stray)} folders that the keys don't name")
        # a folder's rows come together, so that it gets few files; large ones are split
        ready.hint("rebalance", SHARD).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SHARD).parquet(self.folder)
        for shard in set(touched) - held:
            self.delete(f"{self.folder}/{SHARD}={shard}")
        self.delete(staged)
        return touched


def created(rows: DataFrame, key: str, folder: str, shards: int) -> Table:
    """Writes the rows as a new table. All columns come back but nothing else, so a column may not be named like the folders."""
    table = Table(rows.sparkSession, folder, key, shards, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
    rows.withColumn(SHARD, table.shard()).hint("rebalance", SHARD).write.partitionBy(SHARD).parquet(folder)
    return table


def inserted(table: Table, rows: DataFrame) -> list[int]:
    return table.changed(rows.select(table.key), lambda held: held.unionByName(rows.select(held.columns)))


def updated(table: Table, changes: DataFrame, *names: str) -> list[int]:
    """Sets the named columns of the rows whose keys `changes` has, to what it has there; null means not supplied. One change a key."""
    return table.changed(changes.select(table.key), lambda held: patch(held, changes, table.key, *names))


def deleted(table: Table, keys: DataFrame) -> list[int]:
    return table.changed(keys.select(table.key), lambda held: held.join(keys.select(table.key).distinct(), table.key, "left_anti"))
