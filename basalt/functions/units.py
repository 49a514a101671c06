"""Units of measurements: storage to bytes, time to seconds, and metric names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits are eighths of a byte, the prefixes are decimal.
BYTES = {"bits": 0.125, "bytes": 1.0, "kilobits": 125.0, "kilobytes": 1e3, "megabits": 125e3, "megabytes": 1e6, "gigabits": 125e6, "gigabytes": 1e9}
SECONDS = {"nanoseconds": 1e-9, "microseconds": 1e-6, "milliseconds": 1e-3, "seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}


def _looked_up(factors: dict, unit: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in factors.items() for x in pair))[F.lower(unit)]


def base_unit(unit: Column) -> Column:
    """bytes for storage, seconds for time, else the unit itself."""
    return F.when(F.lower(unit).isin(*BYTES), "bytes").when(F.lower(unit).isin(*SECONDS), "seconds").otherwise(unit)


def converted(value: Column, unit: Column) -> Column:
    """value in its base unit; as it is where the unit is unknown or null."""
    return value * F.coalesce(_looked_up(BYTES, unit), _looked_up(SECONDS, unit), F.lit(1.0))


def metric_name(name: Column, kind: Column, suffix: Column | None = None, unit: Column | None = None) -> Column:
    """name[_suffix]_kind[_unit]; spaces in the kind become underscores, null parts are left out."""
    none = F.lit(None).cast("string")
    return F.concat_ws("_", name, none if suffix is None else F.nullif(suffix, F.lit("")), F.regexp_replace(F.lower(kind), " ", "_"), none if unit is None else F.nullif(unit, F.lit("")))
