"""Chat messages (conv_id, turn, role, text): concatenation, usage, histograms, memory, rules, token streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.text import full_match, replace_first, split_keeping, token_estimate

ROLES = ("user", "assistant", "system")
#: Upper bounds of histogram buckets: powers of four for tokens, powers of two from 0.01 for seconds.
TOKEN_BOUNDS = tuple(4**k for k in range(14))
SECOND_BOUNDS = tuple(round(0.01 * 2**k, 2) for k in range(14))


def concatenated(messages: DataFrame) -> DataFrame:
    """conv_id and the texts of its user, assistant and system messages in the order of turns, with nothing between."""
    known = messages.where(F.col("role").isin(*ROLES))
    parts = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return known.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def usage(messages: DataFrame) -> DataFrame:
    """conv_id, input_tokens (of what was asked), output_tokens (of the assistant's) and total_tokens, by estimate of the texts put together."""
    chars = lambda answer: F.sum(F.when((F.col("role") == "assistant") == answer, F.length(F.coalesce("text", F.lit("")))).otherwise(0))
    sums = messages.where(F.col("role").isin(*ROLES)).groupBy("conv_id").agg(chars(False).alias("asked"), chars(True).alias("answered"))
    tokens = lambda c: F.floor(F.greatest(F.col(c), F.lit(4)) / 4).cast("long")
    return sums.select("conv_id", tokens("asked").alias("input_tokens"), tokens("answered").alias("output_tokens"), (tokens("asked") + tokens("answered")).alias("total_tokens"))


def histogram(df: DataFrame, by: Sequence[str], value: Column, bounds: Sequence[float]) -> DataFrame:
    """by, bucket (its upper bound, null for the last) and n: how many values are not above it, as cumulative counts. One row a group and bound is shuffled."""
    counts = df.groupBy(*by).agg(*(F.count_if(value <= b).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(value).alias("all"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("bucket"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("bucket"), F.col("all").alias("n")))
    return counts.select(*by, F.explode(rows).alias("x")).select(*by, "x.bucket", "x.n")


def duration_histogram(calls: DataFrame, by: Sequence[str], seconds: Column, truncate: bool = False) -> DataFrame:
    """The histogram of durations; truncate: of whole seconds, which empties the buckets below one."""
    return histogram(calls, by, F.floor(seconds) if truncate else seconds, SECOND_BOUNDS)


def memory(messages: DataFrame, last: int) -> DataFrame:
    """The last messages of every conversation."""
    window = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(window)).where(F.col("back") <= last).drop("back")


def stream(messages: DataFrame) -> DataFrame:
    """conv_id, turn, seq and token: the messages as streams of tokens that make up their texts."""
    return messages.select("conv_id", "turn", F.posexplode(split_keeping(F.col("text"))).alias("seq", "token"))


def assembled(tokens: DataFrame, by: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """The texts that streams of tokens make up, and how many tokens each has."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "token")))
    return tokens.groupBy(*by).agg(F.count("*").alias("n_tokens"), F.array_join(F.transform(parts, lambda p: p["token"]), "").alias("text"))


def until_end(signals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of kind `token` before the first `end` of their stream by seq; an `error` before it fails the query with its token."""
    window = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("kind") == "end").over(window), F.lit(False))
    live = signals.withColumn("ended_", ended).where("not ended_ and kind <> 'end'").drop("ended_")
    token = F.when(F.col("kind") == "error", F.raise_error(F.concat(F.lit("the stream failed: "), F.col("token")))).otherwise(F.col("token"))
    return live.select(*by, "seq", token.alias("token"))


@dataclass(frozen=True)
class Rule:
    """What a text must be, and what to answer.

    A text fits by a predicate (a function from the text's column to a boolean one) if there is one, else if the pattern
    matches all of it. The answer is a function's of the text's column, else a constant, else the text with the
    pattern's first match replaced, else NO_ANSWER.
    """

    pattern: str = ".*"
    response: str | None = None
    template: str | None = None
    predicate: Callable[[Column], Column] | None = None
    responder: Callable[[Column], Column] | None = None


NO_ANSWER = "no response"


def answered(messages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """messages with rule (its place, null if none matches) and answer of the first rule that matches."""
    rule, answer = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, r in reversed([*enumerate(rules)]):
        fits = full_match(F.col("text"), r.pattern) if r.predicate is None else F.coalesce(r.predicate(F.col("text")), F.lit(False))
        said = r.responder(F.col("text")) if r.responder is not None else F.lit(r.response) if r.response is not None else replace_first(F.col("text"), r.pattern, r.template) if r.template is not None else F.lit(NO_ANSWER)
        rule, answer = F.when(fits, k).otherwise(rule), F.when(fits, said).otherwise(answer)
    return messages.withColumns({"rule": rule, "answer": answer})


__all__ = ["NO_ANSWER", "Rule", "answered", "assembled", "concatenated", "duration_histogram", "histogram", "memory", "stream", "token_estimate", "until_end", "usage"]
