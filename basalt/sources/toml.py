"""TOML documents as rows of (path, key, kind, text), as a batch data source and for columns of text.

One document is parsed by the standard library, which reads TOML 1.0; what only 1.1 allows is refused. Kinds: string,
boolean, integer, float, offset_datetime, local_datetime, local_date, local_time. Tables and arrays give no rows of
their own; elements of arrays have their number as the last part of the key. Parts of a key that hold a dot, a tilde
or nothing are written with ~1 for a dot and ~0 for a tilde, so that keys stay unique.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from datetime import date, datetime, time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, key string, kind string, text string"
#: Tables and arrays inside each other at most.
DEEPEST = 100


def escaped(part: str) -> str:
    return part.replace("~", "~0").replace(".", "~1")


def scalar(value: object) -> tuple[str, str]:
    """Kind and text of a TOML scalar."""
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ValueError(f"{value} is no 64-bit integer")
        return "integer", str(value)
    if isinstance(value, float):
        return "float", repr(value)
    if isinstance(value, datetime):
        return ("offset_datetime" if value.tzinfo else "local_datetime"), value.isoformat()
    if isinstance(value, date):
        return "local_date", value.isoformat()
    if isinstance(value, time):
        return "local_time", value.isoformat()
    return "string", str(value)


def entries(text: str, deepest: int = DEEPEST) -> Iterator[tuple[str, str, str]]:
    """Key, kind and text of every scalar, in the document's order. A CR without LF, a wrong document or one too deep is an error."""

    def walk(value: object, key: str, depth: int) -> Iterator[tuple[str, str, str]]:
        if depth > deepest:
            raise ValueError(f"deeper than {deepest} at {key}")
        if isinstance(value, dict | list):
            named = value.items() if isinstance(value, dict) else enumerate(value)
            for name, inner in named:
                yield from walk(inner, f"{key}.{escaped(str(name))}" if key else escaped(str(name)), depth + 1)
        else:
            yield (key, *scalar(value))

    yield from walk(tomllib.loads(text), "", 0)


def parse(df: DataFrame, path: str = "path", content: str = "content", on_error: str = "fail") -> DataFrame:
    """(path, key, kind, text) of the documents in a column; null documents give no rows. on_error="row": a wrong document gives one row of kind `error`."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for where, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if text is None:
                    continue
                try:
                    rows += [(where, *entry) for entry in entries(text)]
                except ValueError as error:
                    if on_error == "fail":
                        raise ValueError(f"{where}: {error}") from error
                    rows.append((where, None, "error", str(error)))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "key", "kind", "text"), row, strict=True)) for row in rows], schema=pa.schema([(c, pa.string()) for c in ("path", "key", "kind", "text")]))

    return df.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(parsed, SCHEMA)


def read(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """The .toml files under a path that any Spark file system reads, a document a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.toml").option("recursiveFileLookup", "true").load(path)
    return parse(files.select("path", F.col("content").cast("string").alias("content")), on_error=on_error)


def as_config(df: DataFrame) -> DataFrame:
    """(path, key, value): scalars as configuration text, with NaN, Infinity and -Infinity for special floats."""
    special = F.create_map(*(F.lit(x) for x in ("nan", "NaN", "inf", "Infinity", "-inf", "-Infinity")))
    value = F.when(F.col("kind") == "float", F.coalesce(special[F.col("text")], F.col("text"))).otherwise(F.col("text"))
    return df.select("path", "key", value.alias("value"))


class TomlSource(DataSource):
    """spark.read.format("toml").load(file or glob on a local path); a partition for each file. For other file systems use read()."""

    @classmethod
    def name(cls) -> str:
        return "toml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("onError", "fail"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, on_error: str):
        self.path, self.on_error = path, on_error

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = [f"{self.path}/**/*.toml"] if os.path.isdir(self.path) else [self.path]
        return [InputPartition(x) for x in sorted(glob.glob(found[0], recursive=True))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8", newline="") as f:
            text = f.read()
        try:
            yield from [(partition.value, *entry) for entry in entries(text)]
        except ValueError as error:
            if self.on_error == "fail":
                raise ValueError(f"{partition.value}: {error}") from error
            yield partition.value, None, "error", str(error)
