"""URL filters: rules for hosts and paths, and for all other urls a classifier of the words in host and path.

Names are split into words by a unigram model: of all splits the Viterbi path finds the likeliest. A multinomial naive
Bayes model scores the words. Both are trained from labelled names, by default the small list below.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Names to learn from when no others are given.
BLOCK_NAMES = (
    "cheap pills", "spam farm", "online casino", "free casino bonus", "poker slots jackpot", "buy cheap viagra", "pharmacy discount pills", "adult xxx video",
    "porn tube", "payday loan", "fast cash loans", "click bait farm", "link farm", "seo spam links", "replica watches", "torrent crack warez", "free download crack keygen",
    "hot singles dating", "weight loss miracle pills", "win free prize", "lottery winner prize", "malware phishing", "fake followers", "betting tips casino", "escort girls", "cheap replica bags", "get rich quick", "ads track banner", "ads popup", "free bets", "casino win", "adult x chat", "track pixel ads", "cheap bets", "spam ads",
)
ALLOW_NAMES = (
    "daily news", "world news archive", "online library", "university research", "science journal", "open source project", "developer docs", "user guide manual", "health center", "city council",
    "history museum", "public school", "music review", "travel guide", "cooking recipes", "weather report", "sports results", "book store", "garden club", "photo gallery",
    "government service", "legal advice", "technical blog", "mail service", "search engine", "encyclopedia article", "forum help", "software download", "data portal", "video lectures", "free software", "farm market", "watch repair", "home page",
)

#: A letter of a name that no known word holds costs as much as a word of this probability and a tenth of it for each letter more.
UNKNOWN = 1e-7


@dataclass
class Model:
    """Costs of known words, and log odds of block over allow by word with the prior's."""

    costs: dict[str, float]
    odds: dict[str, float]
    prior: float
    longest: int


def train(block: Iterator[str] = BLOCK_NAMES, allow: Iterator[str] = ALLOW_NAMES, prior: float = 0.2) -> Model:
    """Counts words of names on either side, add-one smoothed. prior: the share of names to block where nothing else is known."""
    counts = [Counter(w for name in names for w in name.lower().split()) for names in (block, allow)]
    words = {*counts[0], *counts[1]}
    totals = [sum(c.values()) + len(words) for c in counts]
    odds = {w: math.log((counts[0][w] + 1) / totals[0]) - math.log((counts[1][w] + 1) / totals[1]) for w in words}
    every = counts[0] + counts[1]
    costs = {w: -math.log(n / every.total()) for w, n in every.items()}
    return Model(costs, odds, math.log(prior / (1 - prior)), max(map(len, words), default=0))


def split_words(name: str, model: Model) -> list[str]:
    """The likeliest split of a name of letters into known words and unknown letters; unknown letters in a row stay together."""
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
    first, more = -math.log(UNKNOWN), -math.log(0.1)
    for end in range(1, len(name) + 1):
        cost, _, known = best[end - 1]
        found = (cost + (first if known else more), end - 1, False)
        for start in range(max(0, end - model.longest), end):
            if (word := model.costs.get(name[start:end])) is not None:
                found = min(found, (best[start][0] + word, start, True))
        best.append(found)
    parts: list[tuple[int, int, bool]] = []
    end = len(name)
    while end:
        _, start, known = best[end]
        if parts and not known and not parts[-1][2]:
            parts[-1] = (start, parts[-1][1], False)
        else:
            parts.append((start, end, known))
        end = start
    return [name[start:end] for start, end, _ in reversed(parts)]


def tokens(host: str, path: str, model: Model) -> list[str]:
    """Words of all labels of the host but the last, and of the path."""
    labels = host.split(".")[:-1] if "." in host else [host]
    found = []
    for name in re.findall(r"[^\W\d_]+", ".".join(labels) + " " + path.lower()):
        found += split_words(name, model)
    return found


def blocked_odds(host: str, path: str, model: Model) -> float:
    """Log odds that the url is to be blocked; unknown words say nothing."""
    return model.prior + sum(model.odds.get(w, 0.0) for w in tokens(host, path, model))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to /, ?, # or the end, A-Z lower-cased) and path (then up to ?, # or the end); empty without ://."""
    known = F.coalesce(url, F.lit(""))
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(known, pattern, 1), upper, lower), F.regexp_extract(known, pattern, 2)


def judge(df: DataFrame, model: Model | None = None, rules: tuple = RULES, url: str = "url") -> DataFrame:
    """df without the url, with host, path, rule (like `net/`, else null), verdict (allow or block) and odds (the classifier's log odds of block; null under a rule).

    A rule fits its host and all subdomains if the url's path starts with its path; the longest that fits wins. Where
    none fits, the classifier judges. Null urls and urls without :// have an empty host and path, and are allowed by
    the prior. Repeated rows are judged each; an empty table stays empty. Columns named like the new ones are replaced.
    """
    model = model or train()
    new = ("host", "path", "rule", "verdict", "odds")
    host, path = parts(F.col(url))
    base = df.select(*(f"`{c}`" for c in df.columns if c != url and c not in new), host.alias("host"), path.alias("path"))
    fits, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # longer rules are put in front of shorter ones
        fit = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        fits, verdict = F.when(fit, name + start).otherwise(fits), F.when(fit, what).otherwise(verdict)
    base = base.withColumns({"rule": fits, "verdict": verdict})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[str, str], float] = {}
        for batch in batches:
            odds = []
            for h, p, rule in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "rule")), strict=True):
                if rule is not None:
                    odds.append(None)
                    continue
                if (h, p) not in met:
                    if len(met) > 1 << 16:
                        met.clear()
                    met[h, p] = blocked_odds(h, p, model)
                odds.append(met[h, p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.float64())], names=[*batch.schema.names, "odds"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "odds double"])
    return base.mapInArrow(scored, schema).withColumn("verdict", F.coalesce("verdict", F.when(F.col("odds") > 0, "block").otherwise("allow")))
