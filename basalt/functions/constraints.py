"""Schema constraints compiled to Column predicates, and union types.

A constraint is a driver-side description; compiling it gives one expression that Catalyst folds and fuses. A null
column is an absent property and passes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    """What a property may be. Bounds and multiples are decimals, compared exactly; pattern is found anywhere."""

    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    minimum: Decimal | None = None
    exclusive_minimum: bool = False
    maximum: Decimal | None = None
    exclusive_maximum: bool = False
    multiple_of: Decimal | None = None
    min_items: int | None = None
    max_items: int | None = None
    enum: tuple[str, ...] | None = None


def plain_number(value: Column, scale: int = 10) -> Column:
    """A number's text without zeros at the end."""
    text = value.cast(f"decimal(38,{scale})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def check(value: Column, c: Constraint, scale: int = 10) -> Column:
    """Whether a value meets the constraint. scale: decimals of numbers."""
    number = value.cast(f"decimal(38,{scale})")
    bound = lambda x: F.lit(x).cast(f"decimal(38,{scale})")
    tests = []
    if c.min_length is not None:
        tests.append(F.length(value) >= c.min_length)
    if c.max_length is not None:
        tests.append(F.length(value) <= c.max_length)
    if c.pattern is not None:
        tests.append(value.rlike(c.pattern))
    if c.minimum is not None:
        tests.append(number > bound(c.minimum) if c.exclusive_minimum else number >= bound(c.minimum))
    if c.maximum is not None:
        tests.append(number < bound(c.maximum) if c.exclusive_maximum else number <= bound(c.maximum))
    if c.multiple_of is not None:
        tests.append(number % bound(c.multiple_of) == 0)
    if c.min_items is not None:
        tests.append(F.size(value) >= c.min_items)
    if c.max_items is not None:
        tests.append(F.size(value) <= c.max_items)
    if c.enum is not None:
        tests.append(value.cast("string").isin(*c.enum))
    result = F.lit(True)
    for test in tests:
        result = result & test
    return value.isNull() | result


def integral(c: Constraint, low: int = -(1 << 63), high: int = (1 << 63) - 1) -> Constraint:
    """The same bounds for whole numbers, inclusive; a bound beyond the type's range falls away."""
    least = most = None
    if c.minimum is not None:
        least = int(c.minimum.to_integral_value(ROUND_FLOOR)) + 1 if c.exclusive_minimum else int(c.minimum.to_integral_value(ROUND_CEILING))
    if c.maximum is not None:
        most = int(c.maximum.to_integral_value(ROUND_CEILING)) - 1 if c.exclusive_maximum else int(c.maximum.to_integral_value(ROUND_FLOOR))
    inside = lambda x: None if x is None or not low <= x <= high else Decimal(x)
    return replace(c, minimum=inside(least), exclusive_minimum=False, maximum=inside(most), exclusive_maximum=False)


def merged(a: Constraint, b: Constraint) -> Constraint:
    """Both at once: the tighter bound wins, of equal ones the exclusive. Two patterns or multiples that differ, or an empty range, are errors."""

    def tighter(x, y, pick):
        return y if x is None else x if y is None else pick(x, y)

    def only(x, y, what):
        if x is not None and y is not None and x != y:
            raise ValueError(f"two {what}: {x} and {y}")
        return y if x is None else x

    def flag(x, y, fx, fy, low):
        if x is None or y is None or x == y:
            return (x is not None and fx) or (y is not None and fy)
        return fx if (x > y) == low else fy

    out = Constraint(
        tighter(a.min_length, b.min_length, max), tighter(a.max_length, b.max_length, min), only(a.pattern, b.pattern, "patterns"),
        tighter(a.minimum, b.minimum, max), flag(a.minimum, b.minimum, a.exclusive_minimum, b.exclusive_minimum, True),
        tighter(a.maximum, b.maximum, min), flag(a.maximum, b.maximum, a.exclusive_maximum, b.exclusive_maximum, False),
        only(a.multiple_of, b.multiple_of, "multiples"), tighter(a.min_items, b.min_items, max), tighter(a.max_items, b.max_items, min),
        a.enum if b.enum is None else b.enum if a.enum is None else tuple(x for x in a.enum if x in b.enum),
    )
    for low, high, what in ((out.min_length, out.max_length, "length"), (out.minimum, out.maximum, "value"), (out.min_items, out.max_items, "items")):
        strict = what == "value" and (out.exclusive_minimum or out.exclusive_maximum)
        if low is not None and high is not None and (low > high or (strict and low == high)):
            raise ValueError(f"no {what} lies between {low} and {high}")
    return out


def enum_names(values: list[str], c: Constraint = Constraint()) -> dict[str, str]:  # noqa: B008
    """A constant's name for each value of an enumeration; values must differ and meet length and pattern, names that clash get _2, _3."""
    import re

    if len({*values}) < len(values):
        raise ValueError("repeated values")
    taken: dict[str, str] = {}
    for x in values:
        if (c.min_length or 0) > len(x) or len(x) > (math.inf if c.max_length is None else c.max_length) or (c.pattern and not re.search(c.pattern, x)):
            raise ValueError(f"{x!r} doesn't meet its own constraints")
        name = re.sub(r"\W+", "_", x).upper().strip("_") or "EMPTY"
        name = f"_{name}" if name[0].isdigit() else name
        k, free = 2, name
        while free in taken:
            k, free = k + 1, f"{name}_{k}"
        taken[free] = x
    return {x: name for name, x in taken.items()}


def acyclic(models: dict[str, list[str]]) -> None:
    """Raises with the path if a model holds itself, directly or through others."""
    done: set[str] = set()

    def visit(name: str, path: list[str]) -> None:
        if name in path:
            raise ValueError(" -> ".join([*path[path.index(name) :], name]))
        if name not in done:
            for inner in models.get(name, []):
                visit(inner, [*path, name])
            done.add(name)

    for name in models:
        visit(name, [])


def has(value: Column, name: str) -> Column:
    """Whether a JSON object has a property; JSON null counts."""
    return F.try_variant_get(value, f"$.{name}", "variant").isNotNull()


#: What schema_of_variant calls the kinds of JSON values.
KINDS = {"string": "STRING", "number": r"(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def check_property(value: Column, name: str, kind: str | None = None, nullable: bool = False, c: Constraint = Constraint(), scale: int = 10) -> Column:  # noqa: B008
    """Whether a property of a JSON object (a variant) is absent, is JSON null and may be, or is of the kind (a key of KINDS) and meets the constraint."""
    inner = F.try_variant_get(value, f"$.{name}", "variant")
    whole = F.try_variant_get(value, f"$.{name}", "array<variant>" if kind == "array" else "string")
    fits = F.lit(True) if kind is None else F.schema_of_variant(inner).rlike(rf"^{KINDS[kind]}\b")
    return F.when(inner.isNull(), True).when(F.is_variant_null(inner), F.lit(nullable)).otherwise(fits & check(whole, c, scale))


def matches_member(value: Column, required: Sequence[str], known: Sequence[str] = (), properties: Sequence[Column] = ()) -> Column:
    """Whether a JSON object has all required properties, or any known one where none is required, and its properties' checks hold."""
    names = F.lit(True)
    for name in required:
        names = names & has(value, name)
    if not required:
        names = F.greatest(F.lit(False), *(has(value, name) for name in known)) if known else F.lit(False)
    for ok in properties:
        names = names & ok
    return names


def one_of(matches: dict[str, Column], discriminator: Column | None = None, aliases: dict[str, str] | None = None, strict: bool = True) -> Column:
    """The member of a union: by the discriminator if one is given, else the only one that matches; null if none or several do.

    A discriminator that is null or names no member is an error; with strict=False it gives null.
    """
    n = sum((F.coalesce(m, F.lit(False)).cast("int") for m in matches.values()), F.lit(0))
    name = F.coalesce(*(F.when(F.coalesce(m, F.lit(False)), F.lit(k)) for k, m in matches.items()))
    structural = F.when(n == 1, name)
    if discriminator is None:
        return structural
    known = F.create_map(*(F.lit(x) for pair in (aliases or {k: k for k in matches}).items() for x in pair))
    named = F.try_element_at(known, discriminator)
    wrong = F.when(discriminator.isNull(), F.lit("no discriminator")).otherwise(F.concat(F.lit("no member for discriminator "), discriminator))
    return F.when(named.isNotNull(), named).otherwise(F.raise_error(wrong)) if strict else named


def any_of_best(scores: dict[str, Column]) -> Column:
    """The member with the highest score above 0; null if none has one, or two share it."""
    pairs = F.array(*(F.struct(F.coalesce(s, F.lit(0)).cast("double").alias("score"), F.lit(k).alias("name")) for k, s in scores.items()))
    best = F.array_max(F.transform(pairs, lambda p: p["score"]))
    top = F.filter(pairs, lambda p: p["score"] == best)
    return F.when((best > 0) & (F.size(top) == 1), F.get(top, F.lit(0))["name"])
