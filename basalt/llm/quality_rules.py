"""Quality rules with DataFrame functions only: base rules of length and repetition, then divergence from language references.

A document's histogram of character classes and of common words is compared with its language's by Jensen-Shannon
distance. The references are the histograms of all documents of the language that pass the base rules, so they follow
the corpus; documents too short for a histogram to say anything pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm import common

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WIDTH = 5
#: Base: fewer words fail, and more than one repeated word in so many.
LEAST_WORDS, REPEATED = 10, (100, 20)

# Frequent words of the four languages.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "was", "on", "be", "by", "this", "are"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
}
WORDS = tuple(dict.fromkeys(w for group in COMMON_WORDS.values() for w in group))
#: Character classes counted by pattern; white space and all others (lower-case letters above all) come from the lengths.
CLASSES = (("upper", r"[A-Z]+"), ("digit", r"[0-9]+"), ("foreign", r"[^\x00-\x7F]+"), ("mark", r"[!-/:-@\[-`{-~]+"))

#: Languages up to which the references, some 400 bytes each, are broadcast.
LANGUAGES = 10_000
#: Guard: words from which on a histogram is compared.
LEAST_COMPARED = 30
#: A document is rejected beyond either distance, or beyond both of a smaller pair.
FARTHEST_CLASSES, FARTHEST_WORDS = 0.24, 0.45
BOTH_CLASSES, BOTH_WORDS = 0.1, 0.3


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once for a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def matched(text: Column, pattern: str) -> Column:
    """Characters of text that runs of the pattern hold."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column, width: int = WIDTH) -> Column:
    """Words in windows of `width` words that a text has twice or more, windows compared by a 64-bit hash."""

    def windows(w: Column) -> Column:
        at = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))
        return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), at)).otherwise(F.array().cast("array<long>"))

    def covered(h: Column) -> Column:
        in_order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            mate = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + d)["h"], F.lit(False))
            found = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when((mate(k, -1) & (k > 0)) | mate(k, 1), F.get(s, k)["i"]))
            return F.array_sort(F.array_compact(found))

        def total(p: Column) -> Column:
            step = lambda k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(width)))
            return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, k: a + step(k))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(bound(in_order, twice), total))

    return bound(bound(words, windows), covered)


def facts(df: DataFrame) -> DataFrame:
    """doc_id, lang and per document the base counts and the two histograms (classes, words) as arrays of counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    known = list(WORDS)

    def of_words(w: Column) -> Column:
        hits = F.filter(F.transform(w, F.lower), lambda x: x.isin(known))
        each = bound(hits, lambda h: F.concat(F.array(*(F.size(h) - F.size(F.array_remove(h, x)) for x in known)), F.array(F.size(w) - F.size(h))))
        return F.struct(
            F.size(w).alias("n_words"),
            F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            each.alias("words"),
        )

    base = df.select(
        "doc_id",
        "lang",
        bound(words_of(text), of_words).alias("w"),
        matched(text, SYMBOLS).alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        F.array(F.length(text), *(matched(text, pattern) for _, pattern in CLASSES)).alias("c"),
    )
    blank = F.get("c", F.lit(0)) - F.col("w.word_chars")
    counted = F.slice("c", 2, len(CLASSES))
    rest = F.col("w.word_chars") - F.aggregate(counted, F.lit(0), lambda a, x: a + x)
    n, r = F.col("w.n_words"), F.col("w.n_repeat_words")
    return base.select(
        "doc_id", "lang", n.alias("n_words"), F.col("w.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", r.alias("n_repeat_words"),
        ((n < LEAST_WORDS) | (REPEATED[0] * r.cast("long") > REPEATED[1] * n)).alias("base_failed"), F.concat(counted, F.array(blank, rest)).alias("classes"), F.col("w.words").alias("words"),
    )


def references(known: DataFrame) -> DataFrame:
    """lang and its two histograms, over all documents that pass the base rules."""
    good = known.where(~F.col("base_failed") & F.col("lang").isNotNull())
    total = lambda name, n: F.array(*(F.sum(F.get(name, F.lit(k)).cast("long")) for k in range(n))).alias(f"{name}_reference")
    return good.groupBy("lang").agg(total("classes", len(CLASSES) + 2), total("words", len(WORDS) + 1))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts, 0 to 1; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def of(pair: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: bound(F.struct((a / pair["p"]).alias("a"), (b / pair["q"]).alias("b")), lambda x: half(x["a"], (x["a"] + x["b"]) / 2) + half(x["b"], (x["a"] + x["b"]) / 2)))
        return F.when((pair["p"] > 0) & (pair["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2)))

    return bound(F.struct(total(p).alias("p"), total(q).alias("q")), of)


def judge(df: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept, class_distance, word_distance.

    df has doc_id, text and lang. Words are runs of characters other than ASCII white space. Null texts count as empty:
    no words, so base_failed. kept is false if base_failed, else whether the distances from the language's reference
    stay within FARTHEST_CLASSES and FARTHEST_WORDS, and one of them within BOTH_CLASSES or BOTH_WORDS; texts of fewer than LEAST_COMPARED words, and those whose
    language is null or has no reference, have null distances and are kept. Repeated rows are judged each; an empty
    table stays empty; extra columns are ignored.
    """
    known = common.stored(facts(df))
    # a row for each language, broadcast where there are few, so that documents of one language don't meet in one task
    reference = common.settled(references(known))
    judged = known.join(F.broadcast(reference) if reference.count() <= LANGUAGES else reference, "lang", "left")
    compared = F.col("n_words") >= LEAST_COMPARED
    judged = judged.select(
        "doc_id", *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed",
        F.when(compared, distance(F.col("classes"), F.col("classes_reference"))).alias("class_distance"), F.when(compared, distance(F.col("words"), F.col("words_reference"))).alias("word_distance"),
    )
    classes, words = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    near = (classes <= FARTHEST_CLASSES) & (words <= FARTHEST_WORDS) & ((classes <= BOTH_CLASSES) | (words <= BOTH_WORDS))
    return judged.withColumn("kept", ~F.col("base_failed") & near)
