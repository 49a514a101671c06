"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters, digits and non-ASCII characters and runs of other characters that aren't white space. A
document is the mean of its tokens' and token pairs' hashed features, so its score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import common

#: Buckets of the hashed features; the weights are as many floats.
BUCKETS = 1 << 18
#: Labelled rows that training takes at most, those with the smallest hash of doc_id; the fit is one bounded task.
TRAIN_ROWS = 8_000
PASSES = 3
#: Follow-the-regularised-leader: step size, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
#: A document's feature values sum up to this.
SCALE = 20.0

SYMBOL = ~common.ALNUM & ~common.BLANK & (np.arange(256) < 128)
SYMBOL[65:91] = False
WORDS = common.ALNUM.copy()
WORDS[65:91] = True


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of a text column: first and last row, the buckets of all features, and their bounds by row."""
    for lo, hi in common.slices(column):
        data, offsets = common.utf8(column.slice(lo, hi - lo))
        parts = [common.spans(data, offsets, inside) for inside in (WORDS, SYMBOL)]
        starts, ends = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        bounds = np.searchsorted(starts, offsets)
        hashed = common.span_hashes(common.LOWER[data], starts, ends)
        shouted = (data[starts] >= 65) & (data[starts] < 91) & (data[np.maximum(ends - 1, 0)] >= 65) & (data[np.maximum(ends - 1, 0)] < 91) & (ends - starts > 1)
        pairs = common.mix(hashed[:-1] * np.uint64(common.BASE) + hashed[1:])
        same = hashed[:-1] == hashed[1:]
        pairs[same] = np.uint64(1)  # one feature for all repeats
        hashed = np.where(shouted, common.mix(hashed + np.uint64(1)), hashed)
        # a row's features: its tokens, then its pairs, which don't reach over its end
        inner = np.ones(max(0, len(hashed) - 1), bool)
        cut = bounds[1:-1]
        inner[cut[(cut > 0) & (cut < len(hashed))] - 1] = False
        row = np.concatenate([common.row_of(bounds), common.row_of(bounds)[:-1][inner] if len(hashed) else np.zeros(0, np.int64)])
        buckets = (np.concatenate([hashed, pairs[inner]]) & np.uint64(BUCKETS - 1)).astype(np.int32)
        order = np.argsort(row.astype(np.uint16) if hi - lo < 1 << 16 else row, kind="stable")
        yield lo, hi, buckets[order], np.searchsorted(row[order], np.arange(hi - lo + 1))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights of all buckets and the bias last, by FTRL-proximal over (buckets, values, label) rows, PASSES times."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(PASSES):
        for buckets, values, label in rows:
            at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            grown = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(slice(None))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Weights learned from labelled rows whose crc32(doc_id as text) mod 3 is not 1, TRAIN_ROWS at most.

    Rows without a label, an id or a text teach nothing. Without any row to learn from the weights are all 0.
    """
    open_ = labels.where(f"{label} is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    chosen = open_.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = common.small_batches(documents).where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buckets, bounds in features(batch.column("text")):
                found, counts = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    x, n = np.unique(buckets[a:b], return_counts=True)
                    found.append(x)
                    counts.append((n * (SCALE / max(1, b - a))).astype(np.float32))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32())), part.column("label")], names=["doc_id", "buckets", "amounts", "label"])

    def fitted(table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table["doc_id"]), np.asarray(table["order"])))
        lists = {c: table[c].combine_chunks() for c in ("buckets", "amounts")}
        starts = np.concatenate([[0], np.cumsum(np.asarray(lists["buckets"].value_lengths(), np.int64))])
        buckets, amounts, labels = (np.asarray(lists["buckets"].flatten()), np.asarray(lists["amounts"].flatten()), np.asarray(table["label"]))
        weights = fit([(buckets[starts[k] : starts[k + 1]], amounts[starts[k] : starts[k + 1]], labels[k]) for k in order])
        at = np.flatnonzero(weights)
        return pa.table({"bucket": pa.array(at, pa.int32()), "weight": pa.array(weights[at])})

    counts = rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(counted, "doc_id long, buckets array<int>, amounts array<float>, label int")
    # TRAIN_ROWS rows at most, in an order that doesn't depend on where they come from
    one = counts.dropDuplicates(["doc_id"]).withColumn("order", F.xxhash64("doc_id", F.lit(1))).withColumn("all", F.lit(0))
    learned = one.groupBy("all").applyInArrow(fitted, "bucket int, weight double").toArrow()
    out = np.zeros(BUCKETS + 1)
    out[np.asarray(learned["bucket"], np.int64)] = np.asarray(learned["weight"])
    return out


def score(df: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """df with score (double, 0 to 1: higher is better) and predicted (int, 1 if score >= 0.5) of each whole text.

    Null and empty texts and texts of white space get the bias's score. Repeated rows are scored each; an empty table
    stays empty. Columns named like the new ones are replaced.
    """
    keep = [c for c in df.columns if c not in ("score", "predicted")]
    sent = df.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            found = [np.zeros(0)]
            for _, _, buckets, bounds in features(batch.column(text)):
                sums = np.concatenate([np.zeros(1), np.cumsum(weights[buckets])])
                found.append((sums[bounds[1:]] - sums[bounds[:-1]]) * (SCALE / np.maximum(1, np.diff(bounds))) + weights[-1])
            chance = 1 / (1 + np.exp(-np.clip(np.concatenate(found), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "score double", "predicted int"])
    return common.small_batches(df).select(*(f"`{c}`" for c in keep)).mapInArrow(scored, schema)
