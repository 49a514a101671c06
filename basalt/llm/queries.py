"""The subpackage's queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import binary_output, decontamination, jaccard_join, license_scan, line_dedup, quality_classifier, quality_rules, sentencepiece_codec, token_counts, url_filters
from basalt.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def piece_model() -> bytes:
    with open(public_tokenizers.path(PIECE_BPE), "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents", "doc_id", "text"), piece_model(), check=True).drop("text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(BYTE_BPE))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "odds")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.token_files(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(BYTE_BPE))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    weights = quality_classifier.train(documents, table(spark, sf_dir, "labels", "doc_id", "quality"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return quality_classifier.score(documents, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: its base counts and rules."""
    return op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: the bytes."""
    return op3_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: host, path, rule, and its verdict."""
    return op4_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: words and the base phrases' places."""
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


NUMBERED = (op1_sentencepiece, op2_quality_rules, op3_token_counts, op4_url_filters, op5_decontamination, op6_binary_output, op7_license_scan, op8_quality_classifier, op9_line_dedup, op10_jaccard_join)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*NUMBERED, quality_base, token_bytes, url_rules, license_phrases)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "quality_base": r"""
WITH w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(5)) AS o) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM (
  SELECT w.doc_id, len(ws) AS n_words, length(list_aggregate(list_concat([''], ws), 'string_agg', ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id)
""",
    "token_bytes": "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes FROM documents",
    "url_rules": f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS r(name, start, verdict))
SELECT p.page_id, any_value(host) AS host, any_value(path) AS path, max_by(name || start, length(name || start)) AS rule, max_by(verdict, length(name || start)) AS rule_verdict
FROM p LEFT JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY p.page_id
""",
    "license_phrases": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
f AS (SELECT * FROM (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) AS f(phrase, label)),
h AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) JOIN f ON ws[i] = phrase[1] AND list_slice(ws, i, i + len(phrase) - 1) = phrase)
SELECT w.doc_id, any_value(len(ws)) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN h ON h.doc_id = w.doc_id GROUP BY w.doc_id
""",
}
