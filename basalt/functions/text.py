"""Scalar functions over text, durations and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """max(length, 4) / 4 in whole numbers; a null text counts as empty. Lengths are code points."""
    return F.floor(F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(4)) / 4).cast("long")


def split_keeping(text: Column) -> Column:
    """Runs of other characters and each white space character by itself; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(r"(\S+|\s)"), F.lit(1))


def full_match(text: Column, pattern: str) -> Column:
    """Whether the pattern matches all of the text."""
    return text.rlike(rf"\A(?:{pattern})\z")


def replace_first(text: Column, pattern: str, template: str) -> Column:
    """text with the first match of the pattern replaced; $1 and so on in the template are its groups. The pattern must not hold a lookbehind."""
    return F.regexp_replace(text, rf"(?s)\A(.*?)(?:{pattern})(.*)\z", _shifted(pattern, template))


def _shifted(pattern: str, template: str) -> str:
    import re

    groups = re.compile(pattern).groups
    return "$1" + re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}" if int(m[1]) else "$0", template) + f"${groups + 2}"


def ttl_text(seconds: Column) -> Column:
    """A duration of whole seconds as `2h`, `90m` or `61s`: the largest unit that holds it without rest."""
    return F.when(seconds % 3600 == 0, F.concat((seconds / 3600).cast("long").cast("string"), F.lit("h"))).when(
        seconds % 60 == 0, F.concat((seconds / 60).cast("long").cast("string"), F.lit("m"))
    ).otherwise(F.concat(seconds.cast("long").cast("string"), F.lit("s")))


def comma_joined(values: Column) -> Column:
    """Elements with commas between and nothing escaped; null for an empty array."""
    return F.when(F.size(values) > 0, F.array_join(values, ","))


def described(text: Column, limit: int = 256, enabled: bool = True) -> Column:
    """A description cut to `limit` characters; null if empty or not enabled."""
    return F.nullif(F.substring(text, 1, limit), F.lit("")) if enabled else F.lit(None).cast("string")


def json_scalar(variant: Column, path: str) -> Column:
    """A JSON scalar as text: null as `null`, missing as null; an array or object is an error."""
    value = F.try_variant_get(variant, path, "variant")
    kind = F.schema_of_variant(value)
    text = F.when(F.is_variant_null(value), F.lit("null")).otherwise(F.variant_get(variant, path, "string"))
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.raise_error(F.lit(f"{path} is no scalar"))).otherwise(text)


def json_value(variant: Column, path: str, kind: str) -> Column:
    """A value at a path as string, int, long, double, boolean, instant, bytes, list, map or object; null where missing, JSON null or not of the kind.

    A blank instant is missing. Elements of lists and values of maps are variants, and an object is a variant itself.
    """
    if kind in ("list", "map"):
        return F.try_variant_get(variant, path, "array<variant>" if kind == "list" else "map<string,variant>")
    if kind == "object":
        inner = F.try_variant_get(variant, path, "variant")
        return F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner)
    text = F.try_variant_get(variant, path, "string")
    if kind == "instant":
        return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))
    if kind == "bytes":
        return F.call_function("try_to_binary", text, F.lit("base64"))
    return F.try_variant_get(variant, path, {"long": "bigint"}.get(kind, kind))


def change_token(version: Column, etag: Column, digest: Column) -> Column:
    """What tells whether something has changed: its version, else a tag that isn't blank, else a hash."""
    return F.coalesce(version.cast("string"), F.nullif(F.trim(etag), F.lit("")), digest)


def common_path(paths: Column) -> Column:
    """The longest common prefix, by segments, of an array of paths; it ends before a {parameter}. `/` if there is none."""
    cut = F.transform(paths, lambda p: F.filter(F.split(p, "/"), lambda s: s != ""))

    def shared(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        first = F.array_position(same, F.lit(False))
        return F.slice(a, F.lit(1), F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int"))

    whole = F.aggregate(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), F.get(cut, F.lit(0)), shared)
    parameter = F.array_position(F.transform(whole, lambda s: s.startswith("{")), F.lit(True))
    kept = F.slice(whole, F.lit(1), F.when(parameter > 0, parameter - 1).otherwise(F.size(whole)).cast("int"))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))
