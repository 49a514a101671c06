"""Metric points from observations: scope filter, roll-ups by kind of meter, unit conversion, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.units import base_unit, converted, metric_name


def scoped(df: DataFrame, scopes: Sequence[str], scope: str = "scope") -> DataFrame:
    """Rows of the scopes, compared in lower case and trimmed; all rows with `*`, otherwise none without a scope."""
    wanted = {s.strip().lower() for s in scopes}
    return df if "*" in wanted else df.where(F.col(scope).isin(*wanted))


def _points(df: DataFrame, by: Sequence[str], parts: list[tuple[str, Column]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(name).alias("suffix"), value.cast("double").alias("value")) for name, value in parts))
    return df.select(*by, F.explode(rows).alias("p")).select(*by, "p.suffix", "p.value").where("value is not null and not isnan(value)")


def counters(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One point a group: how often it was counted."""
    return _points(df.groupBy(*by).agg(F.count("*").alias("n")), by, [("count", F.col("n"))])


def gauges(df: DataFrame, by: Sequence[str], value: str, at: Sequence[str]) -> DataFrame:
    """One point a group: its last value, by the columns of `at`; a value that is no number gives none."""
    return _points(df.groupBy(*by).agg(F.max_by(value, F.struct(*at)).alias("v")), by, [("value", F.col("v"))])


def timers(df: DataFrame, by: Sequence[str], value: str, unit: str = "seconds") -> DataFrame:
    """Count, and mean and maximum in seconds where anything was timed."""
    return summaries(df.withColumn(value, converted(F.col(value), F.lit(unit))), by, value, "seconds")


def summaries(df: DataFrame, by: Sequence[str], value: str, unit: str) -> DataFrame:
    """Count, and mean and maximum where anything was observed, named by the unit."""
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    some = F.col("n") > 0
    return _points(sums, by, [(f"{unit}_count", F.col("n")), (f"mean_{unit}", F.when(some, F.col("mean"))), (f"max_{unit}", F.when(some, F.col("max")))])


def named(points: DataFrame, name: Column, kind: Column, unit: Column | None = None) -> DataFrame:
    """points with their metric name."""
    return points.withColumn("metric", metric_name(name, kind, F.col("suffix"), unit))


def in_base_units(df: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """Values in bytes or seconds, and the unit they are in."""
    return df.withColumns({value: converted(F.col(value), F.col(unit)), unit: base_unit(F.col(unit))})


def batched(df: DataFrame, size: int = 50, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """df with batch: runs of `size` rows in order, the last of each group shorter.

    Without `by` the whole table is numbered: rows are dealt to sorted ranges, whose sizes (a row for each range) give
    where each begins, so that no task sees all rows.
    """
    if by:
        return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    part, place = F.shiftright("place_", 33).cast("int"), F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ranged.select(*df.columns, part.alias("part_"), place.alias("place_"))
    sizes = numbered.groupBy("part_").agg(F.count("*").alias("n_"))
    starts = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("start_"))
    whole = numbered.join(F.broadcast(starts), "part_")
    return whole.select(*df.columns, F.floor((F.col("start_") + F.col("place_")) / size).cast("long").alias("batch"))


def posts(batches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row for each batch: how many points it has."""
    return batches.groupBy(*by, "batch").agg(F.count("*").alias("n_points"))
