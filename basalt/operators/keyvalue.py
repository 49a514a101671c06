"""Versioned keys: a history of (path, version, data, deleted, destroyed), read and changed as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versioned(log: DataFrame, path: str, order: str) -> DataFrame:
    """log with version: 1 for a path's first write, and so on."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy(path).orderBy(order)).cast("long"))


def latest(history: DataFrame) -> DataFrame:
    """Of every path the row with the highest version; none where it is deleted or destroyed."""
    newest = history.groupBy("path").agg(F.max_by(F.struct(*history.columns), "version").alias("r")).select("r.*")
    return newest.where("not deleted and not destroyed")


def at_version(history: DataFrame, version: int) -> DataFrame:
    """The rows of one version that can be read."""
    return history.where((F.col("version") == version) & ~F.col("deleted") & ~F.col("destroyed"))


def create_if_absent(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """history with the rows of fresh (path, data) whose path it doesn't have, as version 1."""
    new = fresh.join(history.select("path").distinct(), "path", "left_anti")
    return history.unionByName(new.select("path", F.lit(1).cast("long").alias("version"), "data", F.lit(False).alias("deleted"), F.lit(False).alias("destroyed")))


def update(history: DataFrame, changes: DataFrame) -> DataFrame:
    """history with the rows of changes (path, data, expected) whose expected version is the path's newest (0: none yet), as the next version."""
    newest = history.groupBy("path").agg(F.max("version").alias("newest"))
    new = changes.join(newest, "path", "left").where(F.coalesce("newest", F.lit(0)) == F.col("expected"))
    return history.unionByName(new.select("path", (F.col("expected") + 1).cast("long").alias("version"), "data", F.lit(False).alias("deleted"), F.lit(False).alias("destroyed")))


def flagged(history: DataFrame, versions: DataFrame, deleted: bool | None = None, destroyed: bool = False) -> DataFrame:
    """history with listed versions (path, version) deleted or undeleted; destroyed: for good, with their data."""
    listed = versions.select("path", "version").distinct().withColumn("hit_", F.lit(True))
    joined = history.join(listed, ["path", "version"], "left")
    hit = F.coalesce("hit_", F.lit(False))
    out = joined.withColumn("deleted", F.when(hit & F.lit(deleted is not None), F.lit(bool(deleted))).otherwise(F.col("deleted")))
    if destroyed:
        out = out.withColumns({"destroyed": hit | F.col("destroyed"), "data": F.when(~hit, F.col("data"))})
    return out.select(*history.columns)


def delete_all(history: DataFrame, paths: DataFrame) -> DataFrame:
    return history.join(paths.select("path").distinct(), "path", "left_anti")


def put(table: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """An unversioned table with rows in place of those with the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)
