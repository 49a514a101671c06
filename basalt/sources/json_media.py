"""JSON text in and out: reading with a charset, writing with a writer's switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: StructType | str, charset: str = "UTF-8", lenient: bool = False, many: bool = False) -> DataFrame:
    """Documents of a known schema; many: whole files, each an object or a list of them. A wrong document is an error."""
    reader = spark.read if many or charset.upper() == "UTF-8" else spark.read.option("lineSep", "\n")  # Spark finds line ends by itself in UTF-8 only
    return (
        reader.schema(schema)
        .option("encoding", charset)
        .option("multiLine", many)
        .option("mode", "FAILFAST")
        .option("allowComments", lenient)
        .option("allowUnquotedFieldNames", lenient)
        .option("allowSingleQuotes", lenient)
        .option("allowNonNumericNumbers", lenient)
        .json(path)
    )


def write_json(df: DataFrame, path: str, charset: str = "UTF-8", nulls: bool = False) -> None:
    """A JSON document a row, in the charset that was agreed on."""
    df.write.option("encoding", charset).option("ignoreNullFields", not nulls).option("lineSep", "\n").json(path)


def render_entries(entries: Column) -> Column:
    """The JSON text of a map whose keys are no plain names: a list of [key, value] pairs."""
    text = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    pairs = F.transform(F.map_entries(entries), lambda e: F.concat(F.lit("["), text(e["key"]), F.lit(","), text(e["value"]), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]"))


#: What a writer escapes inside strings so that a page may hold the text.
HTML = (("<", r"\\u003c"), (">", r"\\u003e"), ("&", r"\\u0026"), ("=", r"\\u003d"), ("'", r"\\u0027"))


def render(value: Column, pretty: bool = False, nulls: bool = False, escape_html: bool = False) -> Column:
    """The JSON text of a struct, map or array. nulls: fields that are null are written; escape_html: <, >, &, = and ' as escapes."""
    text = F.to_json(value, {"pretty": str(pretty).lower(), "ignoreNullFields": str(not nulls).lower()})
    for mark, escape in HTML if escape_html else ():
        text = F.regexp_replace(text, mark, escape)
    return text
