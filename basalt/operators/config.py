"""Layered configuration: components over providers' defaults, and the components that are named."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(layers: DataFrame, by: tuple[str, ...] = ("name", "key"), level: str = "level") -> DataFrame:
    """Of each name and key the value of the highest level: a value, or a whole list, replaces what lies below."""
    window = Window.partitionBy(*by).orderBy(F.desc(level))
    return layers.withColumn("k_", F.rank().over(window)).where("k_ = 1").drop("k_")


def named_components(config: DataFrame, category: str, provider: str) -> DataFrame:
    """Names of a category's components whose `provider` is the given one."""
    return config.where((F.col("category") == category) & (F.col("key") == "provider") & (F.col("value") == provider)).select("name").distinct()


def enabled(components: DataFrame, flag: str = "enabled") -> DataFrame:
    """Components that aren't switched off; without the flag they are on."""
    return components.where(F.coalesce(F.col(flag), F.lit(True)))


def default_component(components: DataFrame, name: str = "name", weight: str = "weight", by: tuple[str, ...] = ()) -> DataFrame:
    """The component with the highest weight, of each `by` where given; ties by name."""
    return components.groupBy(*by).agg(F.max_by(name, F.struct(F.col(weight), F.col(name))).alias(name))


def united(*lists: Column) -> Column:
    """All elements of lists one after the other; a null list has none."""
    return F.flatten(F.array_compact(F.array(*lists)))


def reloaded(installed: tuple[str, ...] | None, current: tuple[str, ...], load: Callable[[], DataFrame], held: DataFrame | None = None) -> tuple[tuple[str, ...] | None, DataFrame | None]:
    """The tokens and table to use from now on: what load() gives if the current tokens differ from the installed ones, else what is held; if loading fails, that too."""
    if installed == current:
        return installed, held
    try:
        fresh = load()
        fresh.schema  # a path that isn't there shows here
    except Exception as error:
        if held is None:
            raise
        warnings.warn(f"the table with tokens {installed} stays: {error}", stacklevel=2)
        return installed, held
    return current, fresh


def resolved(components: DataFrame, stores: DataFrame, models: DataFrame) -> DataFrame:
    """Components with the store and the model they name; a store that is missing is an error, a model may be."""
    s, m = stores.select(F.col("name").alias("store"), F.lit(True).alias("has_store_")), models.select(F.col("name").alias("model"), F.lit(True).alias("has_model_"))
    joined = components.join(s, "store", "left").join(m, "model", "left")
    store = F.when(F.col("has_store_"), F.col("store")).otherwise(F.raise_error(F.concat(F.lit("no store "), F.coalesce("store", F.lit("named")))))
    return joined.select(*(store.alias("store") if c == "store" else F.when(F.col("has_model_"), F.col("model")).alias("model") if c == "model" else F.col(c) for c in components.columns))
