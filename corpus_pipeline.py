"""Training-corpus pipeline: documents through five operators, each stage on what its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import decontamination, jaccard_join, line_dedup, quality_classifier, sentencepiece_codec
from basalt.llm.common import settled, shared_folder, table, without
from basalt.llm.queries import piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The classifier, the fuzzy hashes and the tokenizer aren't SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier, trained on the labelled ones among them, doesn't reject."""
    weights = quality_classifier.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_classifier.score(docs.select(*COLUMNS), weights).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; documents of which nothing is left go."""
    left = line_dedup.dedup_lines(docs.select(*COLUMNS), drop_emptied=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that links of similar documents connect."""
    copies = jaccard_join.jaccard_components(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id").distinct()
    return without(docs.select(*COLUMNS), settled(copies), "doc_id")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves documents out that hold a passage of a benchmark item."""
    found = decontamination.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return without(docs.select(*COLUMNS), settled(found.select("doc_id").distinct()), "doc_id")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document left, checked by decoding them."""
    return sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), piece_model(), check=True).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written as Parquet in the shared folder and read again.

    A row without a doc_id goes through all stages as a document of its own but for decontamination, which names what it
    finds by doc_id. Repeated rows are judged each, and stay or go together. Columns beside the five of documents are left out.
    """
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared}/corpus_pipeline_{uuid.uuid4().hex}_{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
