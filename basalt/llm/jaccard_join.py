"""N-gram Jaccard self-join of documents with a token-group matrix.

1. Every text becomes its set of word shingles (64-bit hashes). Equal sets are one node, so copies need no pairs.
2. A prefix filter bounds what must be compared: of two sets that reach the similarity, the first
   n - ceil(s * n) + 1 shingles of each, rarest first, share one. Frequent shingles only change that order. Places in
   that order bound further: behind the first shared shingle there must be room for the rest of the overlap. Pairs
   that come out are compared by their whole prefixes before their texts are read.
3. Nodes are partitioned into groups of similar ones: a shingle's leader is the node where it comes first, and every node
   is compared with the leader that it meets most often; what links verify make a group. That is a comparison a node,
   however large a group of near copies is; what its copies share comes first in the text that they were made from.
4. The token-group matrix holds the union of its nodes' prefix shingles for each group. A node's count in a foreign
   group's union bounds its overlap with every node there; only groups that the bound lets through are opened, and
   the nodes in them that their own bound lets through are compared exactly.

Links inside a group needn't be looked for, since only what is connected counts. So the components are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm import common

#: Similarity as a fraction.
UP, DOWN = 4, 5
WIDTH = 5
#: How many of the most frequent shingles the prefix order knows at most; 16 bytes each are broadcast. Only speed depends on it.
FREQUENT = 1 << 20
#: Bits of the filter of shingles that several nodes share, broadcast as 16 MB; a fuller filter only lets more rows through.
FILTER_BITS = 27
#: Shingles in which repeats are counted at once.
COUNTED_TOKENS = 2_000_000
#: Prefix shingles that one task of the sharing test holds.
TASK_TOKENS = 2_000_000
#: Bits of a shingle's hash that the sharing test compares beyond the logarithm of how many there are: about one shingle
#: in 2**SPARE_BITS is taken for another, which only lets its rows through.
SPARE_BITS = 10


def sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of a text column: first and last row, the sorted distinct shingles of each row, their bounds, and each row's node (a hash of its set)."""
    for lo, hi in common.slices(column):
        for a in range(lo, hi, 1 << 15):
            b = min(hi, a + (1 << 15))
            data, offsets = common.utf8(column.slice(a, b - a))
            data = common.LOWER[data]
            starts, ends, bounds = common.spans(data, offsets, ~common.BLANK)
            tokens, bounds = common.shingles(common.span_hashes(data, starts, ends), bounds, width)
            row = common.row_of(bounds).astype(np.uint16)
            order = np.argsort(tokens)
            order = order[np.argsort(row[order], kind="stable")]
            tokens, row = tokens[order], row[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
            tokens, row = tokens[new], row[new]
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(tokens))])
            nodes = common.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
            yield a, b, tokens, bounds, nodes.view(np.int64)


def digests(documents: DataFrame, width: int) -> DataFrame:
    """A row per document (doc_id, node, n), and rows (token, weight) of shingles that several nodes of a run of documents have."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, seen, ids = [np.zeros(0, np.uint64)], np.zeros(0, np.int64), batch.column("doc_id")

            def often() -> pa.RecordBatch:
                tokens, counts = np.unique(np.concatenate(kept), return_counts=True)
                more = counts > 1
                blank = pa.nulls(int(more.sum()), pa.int64())
                kept[1:] = []
                return pa.RecordBatch.from_arrays([blank, blank, blank.cast(pa.int32()), pa.array(tokens[more].view(np.int64)), pa.array(counts[more], pa.int32())], names=names)

            for a, b, tokens, bounds, nodes in sets(batch.column("text"), width):
                n = np.diff(bounds)
                blank = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(nodes, mask=n == 0), pa.array(n, pa.int32()), blank, blank.cast(pa.int32())], names=names)
                first = np.zeros(b - a, bool)
                first[np.unique(nodes, return_index=True)[1]] = True
                first &= ~np.isin(nodes, seen)
                seen = np.concatenate([seen, nodes[first]])
                kept.append(tokens[np.repeat(first, n)])
                if sum(map(len, kept)) > COUNTED_TOKENS:
                    yield often()
            yield often()

    names = ["doc_id", "node", "n", "token", "weight"]
    return documents.mapInArrow(made, "doc_id long, node long, n int, token long, weight int")


def frequent_shingles(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles in ascending order, FREQUENT at most, and the level of each: eight times the binary logarithm of its count."""
    level = F.floor(F.log2(F.sum("weight").cast("double")) * 8).cast("int").alias("level")
    often = common.stored(facts.where("token is not null").groupBy("token").agg(level))
    left, least = FREQUENT, 1 << 30
    for row in sorted(often.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # some hundreds of levels
        left -= row["count"]
        if left < 0:
            break
        least = row["level"]
    found = often.where(F.col("level") >= least).toArrow()
    tokens, levels = np.asarray(found["token"], np.int64).view(np.uint64), np.asarray(found["level"], np.int64)
    order = np.argsort(tokens)
    return tokens[order], levels[order]


def prefixes(documents: DataFrame, digest: DataFrame, frequent: np.ndarray, weights: np.ndarray, width: int) -> DataFrame:
    """Per node of documents with an id and words: node, doc (one's id), n and the first n - ceil(s * n) + 1 shingles, rarest first.

    Only nodes that several documents have are shuffled to be rid of repeats.
    """
    near = np.zeros(1 << 22, bool)
    near[(frequent & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seen = batch.column("doc_id"), np.zeros(0, np.int64)
            for a, b, tokens, bounds, nodes in sets(batch.column("text"), width):
                n = np.diff(bounds)
                row = common.row_of(bounds)
                weight = np.zeros(len(tokens), np.int64)
                maybe = np.flatnonzero(near[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)])
                if len(maybe) and len(frequent):
                    at = np.minimum(np.searchsorted(frequent, tokens[maybe]), len(frequent) - 1)
                    weight[maybe] = np.where(frequent[at] == tokens[maybe], weights[at], 0)
                    tokens = tokens[np.argsort(row * (int(weights.max()) + 1) + weight, kind="stable")]
                taken = n - -(-UP * n // DOWN) + 1
                take = np.flatnonzero((n > 0) & np.asarray(ids.slice(a, b - a).is_valid()) & ~np.isin(nodes, seen))
                take = take[np.unique(nodes[take], return_index=True)[1]]
                seen = np.concatenate([seen, nodes[take]])
                counts = taken[take]
                ends = np.cumsum(counts)
                at = np.arange(counts.sum()) - np.repeat(ends - counts, counts) + np.repeat(bounds[:-1][take], counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tokens[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[take]), ids.slice(a, b - a).take(pa.array(take)), pa.array(n[take], pa.int32()), lists], names=["node", "doc", "n", "prefix"])

    copied = common.stored(digest.where("node is not null").groupBy("node").agg(F.count("*").alias("k")).where("k > 1").select("node"))
    rows = common.stored(common.marked(documents.mapInArrow(made, "node long, doc long, n int, prefix array<long>"), copied, "node"))
    once = common.stored(rows.where("may_join_").drop("may_join_").dropDuplicates(["node"]))
    return rows.where("not may_join_").drop("may_join_").unionByName(once)


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a batch of prefixes, and the row of each."""
    lists = batch.column("prefix")
    lengths = np.asarray(lists.value_lengths(), np.int64)
    return np.asarray(lists.flatten(), np.int64).view(np.uint64), np.repeat(np.arange(len(lengths)), lengths)


def shared_filter(nodes: DataFrame, total: int) -> np.ndarray:
    """A bitmap over the highest FILTER_BITS bits of shingles' mixed hashes (prefixes hold the smallest unmixed ones): set where a shingle is in the prefixes of two nodes or more.

    Each batch sends a shingle at most twice, so no shingle is large; each task tests a range of shingles and makes
    its stretch of the bitmap, whose whole size is fixed. Hashes are sent as their highest bytes, a plane for each byte,
    since sorted ones share the first.
    """
    sent = min(8, max(-(-FILTER_BITS // 8), -(-(total.bit_length() + SPARE_BITS) // 8)))
    buckets = 1 << max(6, min(FILTER_BITS - 3, (max(1, total // TASK_TOKENS) - 1).bit_length()))
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    span = (1 << FILTER_BITS) // buckets

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, counts = np.unique(common.mix(flat(batch)[0]) >> np.uint64(64 - 8 * sent) << np.uint64(64 - 8 * sent), return_counts=True)
            tokens = np.repeat(tokens, np.minimum(counts, 2))
            planes = tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :sent]
            cuts = np.searchsorted(tokens >> shift, np.arange(buckets + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([planes[cuts[k] : cuts[k + 1]].T.tobytes() for k in some], pa.binary())], names=["bucket", "tokens"])

    def tested(group: pa.Table) -> pa.Table:
        whole = np.concatenate([np.frombuffer(x, np.uint8).reshape(sent, -1) for x in group["tokens"].to_pylist()], axis=1)
        tokens = np.zeros(whole.shape[1], np.uint64)
        for k in range(sent):
            tokens |= whole[k].astype(np.uint64) << np.uint64(56 - 8 * k)
        tokens.sort()
        twice = tokens[1:][tokens[1:] == tokens[:-1]]
        bucket = group["bucket"][0].as_py()
        bits = np.zeros(span, bool)
        bits[(twice >> np.uint64(64 - FILTER_BITS)).astype(np.int64) - bucket * span] = True
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    found = nodes.select("prefix").mapInArrow(dealt, "bucket int, tokens binary").groupBy("bucket").applyInArrow(tested, "bucket int, bits binary").collect()
    whole = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for x in found:
        whole[x["bucket"] * span // 8 : (x["bucket"] + 1) * span // 8] = np.frombuffer(x["bits"], np.uint8)
    return whole


def live_prefixes(nodes: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(node, n, tokens, spots) with the prefix shingles that the filter lets through, of nodes that have any; spots: the shingle's place in the node's order in the high half, the node's shingles in the low one."""
    sent = nodes.sparkSession.sparkContext.broadcast(bitmap)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sent.value
        for batch in batches:
            tokens, row = flat(batch)
            spot = (np.arange(len(row)) - np.searchsorted(row, row) << 32) + np.asarray(batch.column("n"), np.int64)[row]
            at = (common.mix(tokens) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            on = (whole[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            counts = np.bincount(row[on], minlength=batch.num_rows)
            some = pa.array(np.flatnonzero(counts))
            ends = pa.array(np.concatenate([[0], np.cumsum(counts[counts > 0])]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[on])) for x in (tokens.view(np.int64), spot)]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(some), batch.column("n").take(some), *lists], names=["node", "n", "tokens", "spots"])

    return nodes.select("node", "n", "prefix").mapInArrow(made, "node long, n int, tokens array<long>, spots array<long>")


def n_of(spot: str) -> Column:
    return F.col(spot).bitwiseAND(F.lit(0xFFFFFFFF))


def rest_of(spot: str) -> Column:
    """Shingles of the node from this one on."""
    return n_of(spot) - F.shiftright(spot, 32)


def needed(a: Column, b: Column) -> Column:
    """The overlap of sets of a and b shingles from which on they link."""
    return F.ceil((a + b) * UP / F.lit(UP + DOWN) - F.lit(1e-9))


def behind(n: Column) -> Column:
    """Shingles of a set behind its prefix."""
    return F.ceil(n * UP / F.lit(DOWN) - F.lit(1e-9)) - 1


def room(n: Column, rest: Column, low: Column, other: Column) -> Column:
    """Whether a set of n shingles may first share a shingle, behind which it has `rest` with it, with a set of `low` shingles or more that has `other` at most."""
    least = needed(n, F.greatest(low, F.ceil(n * UP / F.lit(DOWN) - F.lit(1e-9))))
    return (rest >= least) & (other >= least)


def plausible(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough: the overlap is at most what they share and what lies behind either. What two prefixes share is among the shingles of live_prefixes."""
    pairs = common.settled(pairs)
    both = common.joinable(live.select("node", "n", "tokens"), pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    joined = pairs.join(both.toDF("a", "n", "x"), "a").join(both.toDF("b", "bn", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return joined.where(shared + F.greatest(behind(F.col("n")), behind(F.col("bn"))) >= needed(F.col("n"), F.col("bn"))).select("a", "b")


def packed(texts: DataFrame) -> DataFrame:
    """(doc_id, text) with the texts compressed, as they are shuffled to their pairs."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([zlib.compress((x or "").encode(), 3) for x in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "text"])

    return texts.mapInArrow(made, "doc_id long, text binary")


def unpacked(column: pa.Array) -> pa.Array:
    return pa.array([zlib.decompress(x).decode() for x in column.to_pylist()], pa.string())


def verified(pairs: DataFrame, nodes: DataFrame, live: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose documents' sets link, by their exact overlap."""
    pairs = plausible(pairs, live)
    at = nodes.select("node", "doc")
    joined = pairs.join(at.toDF("a", "doc_a"), "a").join(at.toDF("b", "doc_b"), "b")
    joined = common.settled(joined)
    wanted = joined.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    texts = packed(common.joinable(documents, wanted, "doc_id"))
    joined = joined.join(texts.toDF("doc_a", "text_a"), "doc_a").join(texts.toDF("doc_b", "text_b"), "doc_b").select("a", "b", "text_a", "text_b")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, held = None, None
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            a, b = (np.asarray(batch.column(c), np.int64) for c in "ab")
            ok = np.zeros(len(a), bool)
            for lo, _, tokens, bounds, nodes in sets(unpacked(batch.column("text_a")), width):
                for k in np.flatnonzero(nodes == a[lo : lo + len(nodes)]):
                    i = int(lo + k)
                    if leader != b[i]:
                        whole = next(iter(sets(unpacked(batch.column("text_b").slice(i, 1)), width)))
                        if whole[4][0] != b[i]:  # another text under the same id
                            continue
                        leader, held = b[i], whole[2]
                    own = tokens[bounds[k] : bounds[k + 1]]
                    at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                    both = int((held[at] == own).sum())
                    ok[i] = DOWN * both >= UP * (len(own) + len(held) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return joined.mapInArrow(tested, "a long, b long")


def jaccard_components(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of df (doc_id, text): doc_id, n_shingles (long, size of its set), component_id (smallest doc_id that links reach, its own included).

    Words are runs of bytes that are not ASCII white space, A-Z lower-cased; fewer words than `width` are one shingle.
    Two documents link when 5 * overlap >= 4 * union. Null texts and texts without words have the empty set and link
    with nothing. A row without a doc_id has a count and a null component. Repeated rows are returned each; rows that
    share a doc_id but not a text are nodes of their own, and component_id is the smallest id among a row's node's
    links. Extra columns are ignored. An empty table gives an empty table.
    """
    documents = common.small_batches(df).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = common.stored(digests(documents, width))
    digest = facts.where("n is not null").select("doc_id", "node", "n")
    frequent, weights = frequent_shingles(facts)
    nodes = prefixes(documents, digest, frequent, weights, width)
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    live = common.stored(live_prefixes(nodes, shared_filter(nodes, total)))
    rows = live.select("node", F.explode(F.arrays_zip("tokens", "spots")).alias("x")).select(F.col("x.tokens").alias("token"), "node", F.col("x.spots").alias("spot"))
    first = F.min(F.struct("spot", "node")).alias("l")
    shared = rows.groupBy("token").agg(first, F.count("*").alias("k"), F.min(n_of("spot")).alias("low"), F.max(rest_of("spot")).alias("most")).where("k > 1")
    met = rows.join(shared, "token").where(room(n_of("spot"), rest_of("spot"), F.col("low"), F.col("most")))
    rows = common.stored(met.select("token", "node", "spot", F.col("l.node").alias("b"), F.col("l.spot").alias("bspot")))

    # groups: of the nodes that come first under a node's shingles, the one that it meets most often
    fits = (n_of("spot") * DOWN >= n_of("bspot") * UP) & (n_of("bspot") * DOWN >= n_of("spot") * UP)
    fits &= room(n_of("spot"), rest_of("spot"), n_of("bspot"), rest_of("bspot")) & room(n_of("bspot"), rest_of("bspot"), n_of("spot"), rest_of("spot"))
    star = rows.where("node <> b").where(fits).groupBy("node", "b").agg(F.count("*").alias("c"))
    star = star.groupBy("node").agg(F.max(F.struct("c", "b")).alias("l")).select(F.col("node").alias("a"), F.col("l.b").alias("b"))
    links = common.settled(verified(star, nodes, live, documents, width))
    groups = common.components(links).toDF("node", "g")

    # the token-group matrix, and nodes against foreign groups
    grouped = rows.join(groups, "node", "left").select("token", "node", "spot", F.coalesce("g", "node").alias("g"))
    several = grouped.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("token")
    grouped = common.stored(grouped.join(several, "token"))
    matrix = grouped.groupBy("token", F.col("g").alias("h")).agg(F.min(n_of("spot")).alias("low"), F.max(rest_of("spot")).alias("most"))
    spread = grouped.groupBy(F.col("g").alias("h")).agg(F.min(n_of("spot")).alias("low"), F.max(n_of("spot")).alias("high"))
    met = (F.col("q.token") == F.col("m.token")) & (F.col("m.h") < F.col("q.g")) & room(n_of("q.spot"), rest_of("q.spot"), F.col("m.low"), F.col("m.most"))
    bound = grouped.alias("q").join(matrix.alias("m"), met).select("q.node", n_of("q.spot").alias("n"), "m.h").distinct().join(spread, "h")
    low, high = F.greatest("low", F.ceil(F.col("n") * UP / F.lit(DOWN) - F.lit(1e-9))), F.least("high", F.floor(F.col("n") * DOWN / F.lit(UP) + F.lit(1e-9)))
    opened = bound.where(low <= high).select("node", "h")
    inside = grouped.select("token", F.col("node").alias("b"), F.col("spot").alias("bspot"), F.col("g").alias("h"))
    across = grouped.select("token", "node", "spot").join(opened, "node").join(inside, ["token", "h"]).where(fits).select(F.col("node").alias("a"), "b").distinct()
    more = common.settled(verified(across, nodes, live, documents, width))

    roots = common.components(links.unionByName(more)).toDF("node", "root")
    placed = digest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")
    )
