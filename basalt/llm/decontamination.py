"""Benchmark decontamination: passages of documents within a word edit distance of benchmark items.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. The CGK embedding walks over a window of
words: at every step it writes the word it stands on, and moves on if a random bit of that step and word says so. Two
windows a few edits apart are soon written in step again, so edit distance becomes Hamming distance, and the words
written at a few sampled steps are a locality-sensitive hash. Items and all item-sized windows are hashed so REPEATS
times; whatever meets an item under one hash is verified with the exact edit distance.

Before that, windows drop out that can't hold an item: with at most d edits all but d of the item's words are there,
and all but d of those of its words that few other items have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import common

#: Edits allowed for each word of an item.
SHARE = 0.2
#: Items with fewer words allow no edit: all runs of so many words are looked up by one hash instead of the walk's.
LEAST_WORDS = 5
#: Sampled steps of one hash, and hashes; with these, recall of passages at the largest distance is above 0.9 (tests).
SAMPLES, REPEATS = 3, 40
#: The longer a walk, the more edits it has to get over: items with walks over LONG steps are hashed as often by their first
#: EARLY steps alone, so that recall doesn't fall with length.
LONG, EARLY = 96, 64
#: Words of items that one pass over the documents broadcasts: the benchmark is taken in blocks of this size.
BLOCK_WORDS = 200_000
#: A word is rare, by either measure, if at most this share of a batch's words is it. The measures don't change what is found.
RARE = (0.0002, 0.001, 0.004)
#: Repeats of a rare word so near count once in a window.
NEAR = 4
#: Classes of items: lengths from one to below GROWTH times it, and about CLASSES in all so that their words are few.
GROWTH, CLASSES = 1.25, 32


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and bounds."""
    data, offsets = common.utf8(column)
    data = common.LOWER[data]
    starts, ends, bounds = common.spans(data, offsets, common.ALNUM)
    return common.span_hashes(data, starts, ends), bounds


class Hashes:
    """A block of items with its hashes. Symbols: 0 a word of no item, 1 the end of a text, from 2 on the items' words."""

    def __init__(self, ids: list[int], texts: list[str], seed: int = 7):
        hashed, bounds = words(pa.array(texts, pa.string()))
        self.vocabulary = np.unique(hashed)
        symbols = np.searchsorted(self.vocabulary, hashed).astype(np.int32) + 2
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.items = [(i, symbols[a:b]) for i, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True) if b > a]
        lengths = np.array([len(x) for _, x in self.items], np.int64)
        rng = np.random.default_rng(seed)
        allowed = (SHARE * lengths + 1e-9).astype(np.int64)
        #: By number of words below LEAST_WORDS: hashes of the items in order, and the items.
        self.short = {}
        for n in range(1, LEAST_WORDS):
            if len(members := np.flatnonzero(lengths == n)):
                keys = self.runs(np.concatenate([self.items[m][1] for m in members]), np.arange(len(members)) * n, n)
                order = np.argsort(keys, kind="stable")
                self.short[n] = keys[order], members[order]
        #: Random bits by symbol for each hash; all classes share them.
        self.bits = [rng.integers(0, 1 << 63, (2, len(self.vocabulary) + 2), dtype=np.uint64) for _ in range(REPEATS)]
        #: Of each class: least length, reach of a window, edits of each member, its words that it has once, their set, hash tables.
        self.classes = []
        low, size = LEAST_WORDS, max(8, len(self.items) // CLASSES)
        while len(lengths) and low <= lengths.max():
            high = max(low + 1, int(np.ceil(low * GROWTH)))
            inside = np.flatnonzero((lengths >= low) & (lengths < high))
            for members in np.split(inside, range(size, len(inside), size)) if len(inside) else []:
                once = [x[n == 1] for x, n in (np.unique(self.items[m][1], return_counts=True) for m in members)]
                own = np.zeros(len(self.vocabulary) + 2, bool)
                own[np.concatenate(once)] = True
                self.classes.append((low, int((lengths + allowed)[members].max()), allowed[members], once, own, self._tables(low, members, rng)))
            low = high

    def _tables(self, low: int, members: np.ndarray, rng: np.random.Generator) -> list:
        """Per hash: random bits by step and symbol, sampled steps, keys after each of them, and the items by last key."""
        longest = max(len(self.items[m][1]) for m in members)
        text = np.full((len(members), longest + 1), 1, np.int32)
        for k, m in enumerate(members):
            text[k, : len(self.items[m][1])] = self.items[m][1]
        steps = max(SAMPLES + 1, int(1.6 * low))
        tables = []
        for bits, reach in [(b, n) for n in ([steps, EARLY] if steps > LONG else [steps]) for b in self.bits]:
            sampled = np.sort(rng.choice(reach, min(SAMPLES, reach), replace=False))
            keys = [*self.walk(text.ravel(), np.arange(len(members)) * (longest + 1), np.arange(len(members)) * (longest + 1) + np.array([len(self.items[m][1]) for m in members]), bits, sampled)]
            order = np.argsort(keys[-1][1], kind="stable")
            tables.append((bits, sampled, [np.unique(k) for _, k in keys], keys[-1][1][order], members[order]))
        return tables

    @staticmethod
    def walk(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: np.ndarray, sampled: np.ndarray, wanted: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """After each sampled step the windows left and their keys; with `wanted`, only windows whose key it has go on."""
        rows, at, key = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), np.uint64)
        done = 0
        for k, sample in enumerate(sampled):
            for step in range(done, sample):
                move = bits[0][text[at]] >> np.uint64(step & 63)
                if step > 63:
                    move ^= bits[1][text[at]] >> np.uint64(step >> 6 & 63)
                at = np.minimum(at + (move & np.uint64(1)).astype(np.int64), ends)
            done = sample
            key = common.mix(key * np.uint64(common.BASE) + text[at].astype(np.uint64))
            if wanted is not None:
                on = wanted[k][np.minimum(np.searchsorted(wanted[k], key), len(wanted[k]) - 1)] == key
                rows, at, key, ends = rows[on], at[on], key[on], ends[on]
            yield rows, key

    @staticmethod
    def runs(text: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n symbols from each start on."""
        key = np.zeros(len(starts), np.uint64)
        for k in range(n):
            key = common.mix(key * np.uint64(common.BASE) + text[starts + k].astype(np.uint64))
        return key

    def met(self, rows: np.ndarray, key: np.ndarray, keys: np.ndarray, members: np.ndarray) -> np.ndarray:
        """All pairs of a row and an item whose key is the row's, as row * items + item."""
        first, last = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
        n = last - first
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return np.repeat(rows, n) * len(self.items) + members[at]

    def symbols(self, hashed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashed), np.int32)
        maybe = np.flatnonzero(self.near[(hashed & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, hashed[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashed[maybe], at + 2, 0)
        return out

    def windows(self, text: np.ndarray, spread: np.ndarray, base: np.ndarray, of_class: tuple) -> np.ndarray:
        """Starts of the windows that may hold an item of the class: they have as many of the class's rare words as the items keep. base: where all rare words are."""
        _, reach, allowed, once, own, _ = of_class
        starts = None
        for share in sorted(RARE, reverse=True):
            rare = own & (spread <= share * len(text))
            least = min(int(rare[x].sum()) - int(d) for x, d in zip(once, allowed, strict=True))
            if least <= 0:
                continue
            at = base = base[rare[text[base]]]
            for back in range(1, NEAR + 1):  # an item has the word once: of repeats so near one counts
                at = at[(at < back) | (text[at] != text[at - back])]
            # a repeat counts where the one before it may stand in front of the window: in the window's first NEAR places
            again = np.setdiff1d(base, at, assume_unique=True)

            def enough(s: np.ndarray, at: np.ndarray = at, again: np.ndarray = again, least: int = least) -> np.ndarray:
                return np.searchsorted(at, s + reach) - np.searchsorted(at, s) + np.searchsorted(again, s + NEAR) - np.searchsorted(again, s) >= least

            if starts is None:
                first, last = at[: max(0, len(at) - least + 1)], at[least - 1 :]
                close = last - first < reach
                first, low = first[close], np.maximum(last[close] - reach + 1, 0)
                low[1:] = np.maximum(low[1:], first[:-1] + 1)
                n = np.maximum(first - low + 1, 0)
                starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                more = np.unique(again[:, None] - np.arange(NEAR))
                more = more[more >= 0]
                starts = np.union1d(starts, more[enough(more)])
            else:
                starts = starts[enough(starts)]
        starts = np.arange(len(text)) if starts is None else starts
        return starts[text[starts] != 1]

    def candidates(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of all windows that meet an item under one hash. text: symbols with a 1 behind every row; ends: where each symbol's row has it."""
        spread = np.bincount(text, minlength=len(self.vocabulary) + 2)
        spread[:2] = len(text) + 1
        base = np.flatnonzero((spread <= max(RARE) * len(text))[text])
        found = []
        for of_class in self.classes:
            starts, tables = self.windows(text, spread, base, of_class), of_class[-1]
            if not len(starts):
                continue
            for bits, sampled, partial, keys, members in tables:
                rows, key = starts, np.zeros(0, np.uint64)
                for at, key in self.walk(text, starts, ends[starts], bits, sampled, partial):
                    rows = starts[at]
                found.append(self.met(rows, key, keys, members))
        for n, (keys, members) in self.short.items():
            starts = np.flatnonzero((text > 1) & (np.arange(len(text)) + n <= ends))
            found.append(self.met(starts, self.runs(text, starts, n), keys, members))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(1, len(self.items)), pairs % max(1, len(self.items))

    def verified(self, text: np.ndarray, ends: np.ndarray, starts: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which candidates hold their item, the edit distance from the window's start to its best end, and the words up to there."""
        lengths = np.array([len(x) for _, x in self.items], np.int64)
        best, taken = np.full(len(starts), 1 << 30), np.zeros(len(starts), np.int64)
        order = np.argsort(lengths[item], kind="stable")
        for lo in range(0, len(order), 4096):
            part = order[lo : lo + 4096]
            own, n = item[part], lengths[item[part]]
            rows, width = int(n.max()), int((n + SHARE * n).max()) + 1
            pattern = np.full((len(part), rows), -1, np.int32)
            for k, i in enumerate(own):
                pattern[k, : n[k]] = self.items[i][1]
            at = starts[part][:, None] + np.arange(width)
            window = np.where(at < ends[starts[part]][:, None], text[np.minimum(at, len(text) - 1)], -2)
            across = np.arange(width + 1)
            line = np.broadcast_to(across, (len(part), width + 1)).copy()
            for r in range(rows):
                new = np.empty_like(line)
                new[:, 0] = r + 1
                np.minimum(line[:, 1:] + 1, line[:, :-1] + (window != pattern[:, r : r + 1]), out=new[:, 1:])
                new = np.minimum.accumulate(new - across, axis=1) + across
                live = n > r
                line[live] = new[live]
            line[:, 1:][at >= ends[starts[part]][:, None]] = 1 << 29  # no window ends behind its row
            best[part], taken[part] = line.min(axis=1), line.argmin(axis=1)
        return best <= (SHARE * lengths[item] + 1e-9).astype(np.int64) if len(item) else np.zeros(0, bool), best, taken


def contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The passages found: doc_id, item_id, start_word (from 0), n_words and edits, one row for each document row and item, its best passage (fewest edits, then first).

    df has doc_id and text, benchmark item_id and text. An item is found where a run of a document's words is at most
    SHARE times the item's words away from it in edits. Null texts and items, and items without a word,
    are in no passage; a null doc_id is returned as it is. Equal items are found each. Rows that share a
    doc_id are searched each. Extra columns are ignored; an empty table on either side gives no rows.
    """
    documents = common.small_batches(df).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [_found(documents, block) for block in blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else documents.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("item_id", "start_word", "n_words", "edits"))).limit(0)


def blocks(benchmark: DataFrame) -> Iterator[Hashes]:
    """The items in blocks of bounded size, as the driver streams them."""
    ids, texts, size = [], [], 0
    for row in benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        n = len(row["text"].split()) + 1
        if ids and size + n > BLOCK_WORDS:
            yield Hashes(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield Hashes(ids, texts)


def _found(documents: DataFrame, block: Hashes) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(block)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: Hashes = sent.value
        for batch in batches:
            texts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for lo, hi in common.slices(batch.column("text")):
                hashed, bounds = words(batch.column("text").slice(lo, hi - lo))
                texts.append(np.insert(hashes.symbols(hashed), bounds[1:], 1))
                sizes.append(np.diff(bounds) + 1)
            text, sizes = np.concatenate(texts), np.concatenate(sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.cumsum(sizes) - 1
            starts, item = hashes.candidates(text, ends[row])
            ok, edits, taken = hashes.verified(text, ends[row], starts, item)
            starts, item, edits, taken = starts[ok], item[ok], edits[ok], taken[ok]
            own = row[starts]
            order = np.lexsort((starts, edits, item, own))
            own, item, starts, edits, taken = (x[order] for x in (own, item, starts, edits, taken))
            first = np.ones(len(own), bool)
            first[1:] = (own[1:] != own[:-1]) | (item[1:] != item[:-1])
            own, item, starts, edits, taken = (x[first] for x in (own, item, starts, edits, taken))
            named = pa.array([hashes.items[i][0] for i in item], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own)), named, *(pa.array(x.astype(np.int64)) for x in (starts - (ends[own] + 1 - sizes[own]), taken, edits))], names=["doc_id", "item_id", "start_word", "n_words", "edits"])

    return documents.mapInArrow(made, "doc_id long, item_id long, start_word long, n_words long, edits long")
