"""Token ids in binary blocks: Simple-8b words with selectors, escapes and per-block offsets.

A file is a row of a Parquet table in the shared folder: (shard, part, doc_ids, lengths, body). body is little-endian:
magic b"S8B1", uint32 number of ids, uint32 number of words, uint32 offset of the first word of each block of BLOCK ids
with the number of words last, then the words. The high 4 bits of a word select how many ids its low 60 bits hold;
ESCAPE says that the next word is one id of up to 64 bits. No word crosses a block, so blocks decode alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import shared_folder, slices
from basalt.llm.token_counts import gathered, piece_memory, sums

BLOCK = 256
MAGIC = b"S8B1"
#: Ids in a word by selector; each has 60 // count bits.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = 60 // COUNTS
ESCAPE = 15
#: Selectors below FEW hold more ids than a NARROW window shows.
NARROW = 8
FEW = 7


_SHORT = np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.uint8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each unsigned 64-bit integer."""
    out = _SHORT[ids & np.uint64(0xFFFF)]
    for step in (16, 32, 48):
        high = (ids >> np.uint64(step)) & np.uint64(0xFFFF)
        if not high.any() and int(ids.max(initial=0)) >> step == 0:
            break
        out = np.where(high > 0, _SHORT[high] + np.uint8(step), out)
    return out


def encode(ids: np.ndarray) -> bytes:
    """ids (unsigned, up to 64 bits) as a body. All blocks are packed side by side, a word of each at a time."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n, blocks, span = len(ids), -(-len(ids) // BLOCK), int(COUNTS[0])
    padded = np.zeros(blocks * BLOCK + span, np.uint64)
    padded[:n] = ids
    bits = bit_lengths(padded)
    at, ends = np.arange(blocks, dtype=np.int64) * BLOCK, np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    narrow, wide = (np.lib.stride_tricks.sliding_window_view(bits, k) for k in (NARROW, span))
    live, n_words, rounds = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(live):
        here, left = at[live], ends[live] - at[live]
        selector = choose(narrow[here], left)
        more = np.flatnonzero(selector < FEW)  # room for more than the narrow window shows
        if len(more):
            selector[more] = choose(wide[here[more]], left[more])
        escaped = selector == ESCAPE
        took = np.where(escaped, 1, np.minimum(COUNTS[np.minimum(selector, 13)], left))
        words = selector.astype(np.uint64) << np.uint64(60)
        for s in np.flatnonzero(np.bincount(selector[~escaped], minlength=14)):
            rows = np.flatnonzero(selector == s)
            count, width, from_, room = int(COUNTS[s]), np.uint64(BITS[s]), here[rows], left[rows]
            packed = np.zeros(len(rows), np.uint64)
            for k in range(count):
                packed |= np.where(room > k, padded[from_ + k], np.uint64(0)) << np.uint64(k) * width
            words[rows] |= packed
        rounds.append((live, n_words[live], words))
        if escaped.any():
            rounds.append((live[escaped], n_words[live[escaped]] + 1, padded[here[escaped]]))
        n_words[live] += 1 + escaped
        at[live] += took
        live = live[at[live] < ends[live]]
    offsets = np.concatenate([[0], np.cumsum(n_words)])
    out = np.zeros(offsets[-1], "<u8")
    for block, k, words in rounds:
        out[offsets[block] + k] = words
    return MAGIC + np.array([n, len(out)], "<u4").tobytes() + offsets.astype("<u4").tobytes() + out.tobytes()


def choose(window: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first selector, of those that the window's width reaches, whose ids all fit; ESCAPE if none does. What lies behind `left` is free."""
    width = window.shape[1]
    if (left < width).any():
        window = np.where(np.arange(width) < left[:, None], window, 0)
    out = np.full(len(window), ESCAPE)
    most, column = np.zeros(len(window), np.uint8), 0
    for s in range(13, -1, -1):  # from one id a word upwards; a larger count is better while it fits and is needed
        if COUNTS[s] > width:
            break
        while column < COUNTS[s]:
            most = np.maximum(most, window[:, column])
            column += 1
        needed = left > (COUNTS[s + 1] if s < 13 else 0)
        out[(most <= BITS[s]) & needed] = s
    return out


def decode(body: bytes, first: int = 0, blocks: int | None = None) -> np.ndarray:
    """The ids of `blocks` blocks from block `first` on, all by default."""
    if body[:4] != MAGIC:
        raise ValueError("not a Simple-8b body")
    n, n_words = (int(x) for x in np.frombuffer(body, "<u4", 2, 4))
    total = -(-n // BLOCK)
    first = min(first, total)
    upto = total if blocks is None else min(first + blocks, total)
    offsets = np.frombuffer(body, "<u4", total + 1, 12).astype(np.int64)
    words = np.frombuffer(body, "<u8", n_words, 12 + 4 * (total + 1))[offsets[first] : offsets[upto]]
    block = np.repeat(np.arange(first, upto), np.diff(offsets[first : upto + 1]))
    selector = (words >> np.uint64(60)).astype(np.int64)
    # an escape's value follows it; a value may look like an escape itself, so runs of them alternate
    looks = np.flatnonzero(selector == ESCAPE)
    raw = np.zeros(len(words), bool)
    if len(looks):
        run = np.concatenate([[0], np.cumsum(np.diff(looks) > 1)])
        rank = np.arange(len(looks)) - np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])[run]
        raw[looks[rank % 2 == 0] + 1] = True
    heads = np.flatnonzero(~raw)
    escape = selector[heads] == ESCAPE
    held = np.where(escape, 1, COUNTS[np.minimum(selector[heads], 13)])
    # the last word of a block holds what is left of it
    sizes = np.minimum((np.arange(first, upto) + 1) * BLOCK, n) - np.arange(first, upto) * BLOCK
    last = np.searchsorted(block[heads], np.arange(first, upto), side="right") - 1
    through = np.cumsum(held)
    held[last] -= np.diff(through[last], prepend=0) - sizes
    before = np.cumsum(held) - held
    out = np.zeros(sizes.sum(), np.uint64)
    out[before[escape]] = words[heads[escape] + 1]
    for s in np.flatnonzero(np.bincount(selector[heads[~escape]], minlength=14)):
        k = np.flatnonzero(selector[heads] == s)
        value, at, room, mask = words[heads[k]], before[k], held[k], np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s])):
            if j and (short := room <= j).any():
                value, at, room = value[~short], at[~short], room[~short]
            out[at + j] = value & mask
            value = value >> np.uint64(BITS[s])
    return out


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, part_bytes: int = 6 << 20) -> None:
    """Encodes each whole text, appends end_id, and writes the ids of all documents in ascending doc_id order at path.

    Null and empty texts are their end id alone. A null doc_id sorts first; repeated doc_ids are each written, in the
    order of their texts. An empty table writes no rows. Other columns are ignored. Shards are ranges of doc_id, so
    what a lost executor had is encoded again from its range alone.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, shard, part = piece_memory(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in slices(batch.column("text"), part_bytes):
                starts, lengths, bounds = seen.of(batch.column("text").slice(lo, hi - lo))
                n_tokens = sums(lengths, bounds) + 1
                ids = np.insert(gathered(seen.ids, starts, lengths), np.cumsum(n_tokens - 1), end_id)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "doc_ids": [batch.column("doc_id").slice(lo, hi - lo).to_pylist()], "lengths": [n_tokens], "body": [encode(ids)]})
                part += 1

    ranged = df.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(encoded, "shard int, part int, doc_ids array<long>, lengths array<long>, body binary").write.mode("overwrite").option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = memoryview(decode(row["body"]).astype("<u4").tobytes())
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], names=["shard", "part", "doc_id", "within", "n_tokens", "ids_crc32"])

    # a row for each part of some megabytes: sums over them are small, and the window runs over one row a shard
    from pyspark.sql import Window

    parts = files.select("shard", "part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = parts.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    starts = parts.join(F.broadcast(shards), "shard").select("shard", "part", (F.col("before") + F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("base"))
    documents = files.mapInArrow(decoded, "shard int, part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return documents.join(starts, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """write_token_files() to folder, by default a new one under spark.checkpoint.dir, and what read_token_files() gives."""
    spark = df.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/token_files_{uuid.uuid4().hex}"
    write_token_files(df, folder, tokenizer_path, end_id)
    return read_token_files(spark, folder)
