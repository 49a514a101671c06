"""Helpers that several operators share: byte-level word hashing in numpy, table reading, checkpoints, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass holds; memory per pass is about 60 times this.
SLICE_BYTES = 1 << 19

#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


#: Rows of an Arrow batch, unless the session sets a number itself: a worker holds several copies of a batch's texts.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of BATCH_ROWS rows in its session from here on where Spark's default of ten thousand stands."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where the whole session runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints")


def settled(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df cut from its lineage as a Parquet table in the shared folder, for what is large and read by column."""
    path = f"{shared_folder(df.sparkSession)}/stored_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids up to which a bitmap of their hashes tells which rows may join, and 64-bit words of the largest such bitmap, 2 MB, at
#: eight bits an id. It grows with the number of ids, which is counted; with more ids all rows are joined without it.
FILTER_IDS, FILTER_WORDS = 1 << 21, 1 << 18


def marked(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df with may_join_: whether its key has its bit in a bitmap of the ids' hashes; true for every key beyond FILTER_IDS ids."""
    n = ids.count()
    if n > FILTER_IDS:
        return df.withColumn("may_join_", F.col(key).isNotNull())
    words = min(FILTER_WORDS, 1 << max(6, (n // 2).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(words)).alias("slot_")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c, F.lit(1)), F.lit(64)).cast("int"))
    bitmap = ids.where(F.col(key).isNotNull()).groupBy(at(F.col(key))).agg(F.bit_or(bit(F.col(key))).alias("bits_"))
    joined = df.withColumn("slot_", at(F.col(key))).join(F.broadcast(bitmap), "slot_", "left")
    hit = F.coalesce(F.col("bits_").bitwiseAND(bit(F.col(key))) != 0, F.lit(False)) & F.col(key).isNotNull()
    return joined.withColumn("may_join_", hit).drop("slot_", "bits_")


def joinable(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key may be among ids, so that a join needn't shuffle the others."""
    return marked(df, ids, key).where("may_join_").drop("may_join_")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is not among ids: an anti join that only shuffles rows whose key may be."""
    flagged = marked(df, ids, key)
    rest = flagged.where("not may_join_").drop("may_join_")
    return rest.unionByName(flagged.where("may_join_").drop("may_join_").join(ids.select(key).distinct(), key, "left_anti").select(*df.columns)).select(*df.columns)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold at most `most` bytes, or one row."""
    if not len(column):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        upto = max(upto, at + 1)
        yield at, upto
        at = upto


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and where each row starts and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_set(inside: str | bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[np.frombuffer(inside.encode() if isinstance(inside, str) else inside, np.uint8)] = True
    return flags


BLANK = byte_set(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z, and all of every non-ASCII character.
ALNUM = byte_set(b"0123456789abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    grown = _powers.__dict__.setdefault("kept", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(grown[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, factor in enumerate((BASE, INVERSE)):
            line = np.full(size, factor, np.uint64)
            line[0] = 1
            np.multiply.accumulate(line, out=line)
            if size > 1 << 23:  # a single huge text: not kept
                grown = [*grown]
            grown[k] = line
    return grown[0], grown[1]


_spread = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `inside` bytes, runs ending with their row; and the first run of each row, with the total last."""
    flags = np.zeros(len(data) + 2, bool)
    flags[1:-1] = inside[data]
    before, after = flags[:-2].copy(), flags[2:].copy()
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before[edge] = False
    edge = offsets[1:][offsets[1:] > 0] - 1
    after[edge] = False
    flags = flags[1:-1]
    starts, ends = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_spread[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_hash(text: str | bytes) -> int:
    """span_hashes of one whole text, as an unsigned integer."""
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the bounds that spans() gives."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` items, and bounds by row; a row with fewer items has its whole run as one, an empty row none."""
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    new = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(new[-1]) - np.repeat(new[:-1], made) + np.repeat(bounds[:-1], made)
    length = np.repeat(np.minimum(counts, width), made)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        out = mix(out * np.uint64(BASE) + np.where(length > k, padded[at + k], np.uint64(0)) + np.uint64(k + 1))
    return out, new


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) for every id in pairs of ids: the smallest id that links reach.

    Alternates large-star and small-star steps: each moves every neighbourhood to its smallest member, so
    rounds grow with the logarithm of the longest chain. Only ids and labels move; each round is checkpointed.
    """
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = settled(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.explode(F.array("u", "v")).alias("w"), "m").where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        )
        small = settled(small)
        # done when every u has one v and no v is itself a u
        end = lambda c, n, m: F.struct(F.col(c).alias("w"), F.lit(n).alias("n"), F.lit(m).alias("m"))
        ends = small.select(F.inline(F.array(end("u", 1, 0), end("v", 0, 1)))).groupBy("w").agg(F.sum("n").alias("n"), F.max("m").alias("m"))
        open_ = ends.where("n > 1 or (n > 0 and m > 0)")
        edges = small
        if open_.isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")
