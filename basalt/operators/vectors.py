"""Exact retrieval of the nearest vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Query vectors that are broadcast at once; more are taken in blocks.
BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one is null or all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def normalized(vector: Column) -> Column:
    """The vector with length 1; all zeros stay as they are."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(vector, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(v.cast("double")))


def top_k(df: DataFrame, query: Sequence[float], k: int, min_score: float | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows nearest to a query vector with their score, best first, ties by key; none below min_score."""
    scored = df.withColumn("score", cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))).where("score is not null")
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), key).limit(k)


def top_k_each(df: DataFrame, queries: DataFrame, k: int, min_score: float = -1.0, vector: str = "embedding", key: str = "vec_id", query_key: str = "query_id") -> DataFrame:
    """(query_key, key, score, rank) of the k nearest rows of df for each row of queries, ties by key.

    Each batch of df keeps its k best for every query, so what is shuffled is k rows a query and batch, however large
    df is. Queries are broadcast in blocks of BLOCK.
    """
    kinds = df.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    name_type = to_arrow_type(queries.schema[query_key].dataType)
    out = None
    for names, matrix in _blocks(queries.select(query_key, vector)):
        sent = df.sparkSession.sparkContext.broadcast((names, matrix))

        def scored(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, matrix = sent.value
            for batch in batches:
                keys = batch.column(key)
                rows = batch.column(vector)
                if not len(keys):
                    continue
                flat = np.asarray(rows.flatten(), np.float64).reshape(len(keys), -1)
                norm = np.linalg.norm(flat, axis=1)
                scores = np.divide(matrix @ flat.T, norm, out=np.full((len(matrix), len(flat)), -np.inf), where=norm > 0)
                order = np.asarray(keys).argsort(kind="stable")
                best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
                picked = np.take_along_axis(scores, best, axis=1)
                on = np.isfinite(picked) & (picked >= min_score)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in np.nonzero(on)[0]], name_type), keys.take(pa.array(best[on])), pa.array(picked[on])], names=[query_key, key, "score"])

        found = df.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(scored, f"`{query_key}` {kinds[1]}, `{key}` {kinds[0]}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.select(query_key).limit(0).withColumns({key: F.lit(None).cast(kinds[0]), "score": F.lit(0.0), "rank": F.lit(0)})
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    names, rows = [], []
    for name, row in queries.where(F.col(queries.columns[1]).isNotNull()).toLocalIterator():
        names.append(name)
        rows.append(row)
        if len(names) == BLOCK:
            yield names, _unit(rows)
            names, rows = [], []
    if names:
        yield names, _unit(rows)


def _unit(rows: list) -> np.ndarray:
    matrix = np.array(rows, np.float64)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.full_like(matrix, np.nan), where=norm > 0)


def centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """The mean vector of every label."""
    each = df.select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(vector))


def reranked(hits: DataFrame, score: Column, k: int, by: str, key: str) -> DataFrame:
    """The k best hits of each `by` under another score."""
    window = Window.partitionBy(by).orderBy(F.desc("rerank_score"), key)
    return hits.withColumn("rerank_score", score).withColumn("rerank", F.row_number().over(window)).where(F.col("rerank") <= k)


VECTORS = "id string, embedding array<float>, text string, metadata string"


def from_json(spark: SparkSession, path: str | None = None, schema: str = VECTORS) -> DataFrame:
    """The vectors of a JSON file or folder, a document a vector or a list of them; an empty store without a path."""
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
