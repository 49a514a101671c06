"""SentencePiece encoding and decoding by suffix-array matching.

The unseen words of a batch are laid end to end and their suffixes sorted. Every piece of the model is binary-searched
in the suffix array for the range of its occurrences; these are the edges of the words' lattices. Sorted by position,
the edges are relaxed from left to right: of the edges that end at a position, the one survives whose piece merges do
not reach over its start, which is the last piece of the encoding of everything before that position. So the result is
the merge order's own, as the sentencepiece library gives it, and not merely a best-scored path.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from basalt.llm.common import slices
from basalt.llm.token_counts import Memory, _loaded, balanced, gathered, sums

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Ends a word in the text of a batch; no UTF-8 text has it.
END = 0xFF
#: Slots of the memory of piece pairs.
PAIRS = 1 << 20
#: Words that a worker remembers, and bytes of words in one suffix array; a worker's memory is some 300 bytes for each.
REMEMBERED, ARRAY_BYTES = 3 << 17, 1 << 18


@dataclass
class Model:
    """What encoding needs of a model file; ids index all arrays, and the id after the last stands for an unknown character."""

    surfaces: list[bytes]  #: bytes of normal pieces, with a space for SPACE; empty for others
    rank: np.ndarray  #: when a piece is merged, -1 for single characters
    left: np.ndarray
    right: np.ndarray
    merge_keys: np.ndarray  #: left * size + right of all pairs that are a piece together, ascending
    merge_ranks: np.ndarray
    bytes_ids: np.ndarray  #: the piece of each byte
    outputs: list[bytes]  #: what each piece decodes to


def load(model: bytes) -> Model:
    """Reads a BPE model with byte fallback and identity normalisation; other kinds are refused."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
    kinds = np.array([p.type for p in proto.pieces])
    inner = [p.piece for p in proto.pieces if p.type == NORMAL and SPACE in p.piece.lstrip(SPACE)]
    if trainer.model_type != 2 or not trainer.byte_fallback or normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.add_dummy_prefix or not normalizer.escape_whitespaces or (kinds == USER).any() or inner:
        raise ValueError("only BPE models with byte fallback, a dummy prefix and plain text are read")
    size = len(kinds)
    surfaces = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b"" for p in proto.pieces]
    ids = {p.piece.replace(SPACE, " "): i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
    order = sorted(ids, key=lambda x: -proto.pieces[ids[x]].score)
    rank, left, right = np.full(size + 1, -1, np.int64), np.arange(size + 1), np.arange(size + 1)
    keys, ranks = [], []
    scores = {x: k for k, x in enumerate(order) if len(x) > 1}
    for x, k in scores.items():
        for cut in range(1, len(x)):
            if (a := ids.get(x[:cut])) is not None and (b := ids.get(x[cut:])) is not None:
                keys.append(a * (size + 1) + b)
                ranks.append(k)
    for x in order:
        if len(x) > 1:
            i = ids[x]
            split = last_merge(x, scores)
            if split is None:  # no merges lead to this piece, so no text has it
                surfaces[i] = b""
            else:
                left[i], right[i] = ids[split[0]], ids[split[1]]
                rank[i] = max(scores[x], rank[left[i]], rank[right[i]])
    at = np.argsort(keys)
    bytes_ids = np.zeros(256, np.int64)
    for i, p in enumerate(proto.pieces):
        if p.type == BYTE:
            bytes_ids[int(p.piece[1:-1], 16)] = i
    outputs = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else b" \xe2\x81\x87 " if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
    return Model([*surfaces, b""], rank, left, right, np.array(keys, np.int64)[at], np.array(ranks, np.int64)[at], bytes_ids, outputs)


def last_merge(piece: str, scores: dict[str, int]) -> tuple[str, str] | None:
    """The two parts that merge last when the piece itself is encoded; None if it doesn't come out whole."""
    parts = list(piece)
    while len(parts) > 2:
        found = min((scores.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if found[0] == 1 << 60:
            return None
        parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 and parts[0] + parts[1] in scores else None


class Codec(Memory):
    """A worker's encoder: remembered words, pair memory and the pieces in search order."""

    irregular = rf"^$|^ |  |{SPACE}"
    prefix = True

    def __init__(self, model: Model):
        super().__init__(REMEMBERED)
        self.model = model
        self.size = len(model.surfaces)  # with the unknown one
        long = max(map(len, model.surfaces))
        self.words = -(-long // 8)
        self.searched = np.array([i for i, x in enumerate(model.surfaces) if x], np.int64)
        self.lengths = np.array([len(x) for x in model.surfaces], np.int64)
        raw = np.frombuffer(b"".join(model.surfaces[i].ljust(8 * self.words, b"\0") for i in self.searched), ">u8").reshape(-1, self.words)
        self.keys = raw.astype(np.uint64)
        short = np.clip(self.lengths[self.searched, None] - 8 * np.arange(self.words), 0, 8).astype(np.uint64)
        self.masks = np.where(short > 0, ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(short, 1).astype(np.uint64))), np.uint64(0))
        self.pair_keys, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.out_lengths = np.array([*map(len, model.outputs)], np.int64)
        self.out_bytes = np.frombuffer(b"".join(model.outputs), np.uint8)
        self.out_starts = np.cumsum(self.out_lengths) - self.out_lengths

    def cut(self, text: str) -> list[str]:
        return re.split(r"(?<=[^ ])(?= )", " " + text.replace(SPACE, " ")) if text else []

    def _learn(self, words: list[str]) -> None:
        self._each(self.index, words, [" " + x for x in words])

    def _each(self, to: dict[str, int], names: list[str], run: list[str]) -> None:
        at = 0
        for part, _ in balanced(run, ARRAY_BYTES):
            self._add(to, names[at : at + len(part)], *self.encode_words([x.encode() for x in part]))
            at += len(part)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word in a row, and how many each has."""
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        text = np.frombuffer(bytes([END]).join([*words, b""]), np.uint8)
        start, end, piece = self.edges(text)
        return self.relax(text, starts, ends, start, end, piece)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of all pieces, and an unknown edge for each character that is no piece: start, end, piece."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(8 * self.words + 8, np.uint8)])
        packed = np.zeros(n + 8 * self.words, np.uint64)
        for k in range(8):
            packed = (packed << np.uint64(8)) | padded[k : k + len(packed)]
        array = suffix_array(packed, n, self.words)
        low, high = self.ranges(packed, array)
        counts = high - low
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        start, piece = array[at], np.repeat(self.searched, counts)
        end = start + self.lengths[piece]
        heads = np.flatnonzero(((text & 0xC0) != 0x80) & (text != END))
        tails = heads + np.where(text[heads] < 0x80, 1, np.where(text[heads] < 0xE0, 2, np.where(text[heads] < 0xF0, 3, 4)))
        known = np.zeros(n, bool)
        single = self.model.rank[piece] < 0
        known[start[single]] = True
        lone = ~known[heads]
        return np.concatenate([start, heads[lone]]), np.concatenate([end, tails[lone]]), np.concatenate([piece, np.full(lone.sum(), self.size - 1)])

    def ranges(self, packed: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every piece the range of suffixes that begin with it, by two binary searches side by side."""
        found = []
        for after in (False, True):
            low, high = np.zeros(len(self.keys), np.int64), np.full(len(self.keys), len(array), np.int64)
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
                for w in range(self.words):
                    rows = np.flatnonzero(same) if w else np.arange(len(open_))
                    if w:
                        rows = rows[self.masks[open_[rows], w] != 0]
                    if not len(rows):
                        break
                    here = packed[array[middle[rows]] + 8 * w] & self.masks[open_[rows], w]
                    there = self.keys[open_[rows], w]
                    less[rows] |= here < there
                    same[rows] &= here == there
                up = less | same if after else less
                low[open_[up]] = middle[up] + 1
                high[open_[~up]] = middle[~up]
            found.append(low)
        return found[0], found[1]

    def relax(self, text: np.ndarray, word_starts: np.ndarray, word_ends: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Relaxes the edges by where they end in their words, in all words side by side, and reads the pieces back from the ends."""
        word = np.repeat(np.arange(len(word_starts)), word_ends - word_starts + 1)
        inner = end - word_starts[word[start]]  # bytes from the word's start
        order = np.lexsort((start, end, inner))  # at a position the longest piece first
        start, end, piece, inner = start[order], end[order], piece[order], inner[order]
        heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        levels = np.flatnonzero(np.concatenate([[True], np.diff(inner[heads]) > 0, [True]])) if len(heads) else np.zeros(1, np.int64)
        last, from_ = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        first = np.zeros(len(text) + 1, bool)
        first[word_starts] = True
        for lo, hi in zip(levels[:-1], levels[1:], strict=True):
            edge = heads[lo:hi]
            while len(edge):
                before = last[start[edge]]
                ok = first[start[edge]]
                rest = np.flatnonzero(~ok)
                ok[rest] = self.stay(before[rest], piece[edge[rest]])
                taken = edge[ok]
                last[end[taken]], from_[end[taken]] = piece[taken], start[taken]
                edge = edge[~ok] + 1
        reversed_, owner = [], []
        at, live = word_ends.copy(), np.flatnonzero(word_ends > word_starts)
        while len(live):
            here = at[live]
            reversed_.append(here)
            owner.append(live)
            at[live] = from_[here]
            live = live[at[live] > word_starts[live]]
        if not reversed_:
            return np.zeros(0, np.uint32), np.zeros(len(word_starts), np.int64)
        step = np.repeat(np.arange(len(owner)), [*map(len, owner)])
        here, owner = np.concatenate(reversed_), np.concatenate(owner)
        order = np.lexsort((-step, owner))
        here, owner = here[order], owner[order]
        ids = last[here]
        unknown = ids == self.size - 1
        counts = np.where(unknown, here - from_[here], 1)  # an unknown character: its bytes
        at = np.repeat(np.cumsum(counts) - counts, counts)
        within = np.arange(counts.sum()) - at
        out = np.repeat(ids, counts)
        raw = np.repeat(unknown, counts)
        out[raw] = self.model.bytes_ids[text[(np.repeat(from_[here], counts) + within)[raw]]]
        return out.astype(np.uint32), np.bincount(owner, counts, len(word_starts)).astype(np.int64)

    def stay(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the encoding of both pieces' text together is the two pieces; remembered for pairs met before."""
        key = p * self.size + t
        slot = (key * -7046029254386353131 >> 32) & (PAIRS - 1)
        ok = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_keys[slot] != key)
        if len(miss):
            fresh, at = np.unique(key[miss], return_inverse=True)
            known = self._stay(fresh // self.size, fresh % self.size)
            ok[miss] = known[at]
            self.pair_keys[slot[miss]], self.pair_ok[slot[miss]] = key[miss], ok[miss]
        return ok

    def _stay(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Steps back from the last merges on either side of the boundary, and looks whether parts that stand there at the same time merge over it first."""
        m, out = self.model, np.ones(len(u), bool)
        next_u, next_v = np.full(len(u), 1 << 60), np.full(len(u), 1 << 60)
        live = np.arange(len(u))
        while len(live):
            a, b = u[live], v[live]
            key = a * self.size + b
            at = np.minimum(np.searchsorted(m.merge_keys, key), len(m.merge_keys) - 1)
            rank = np.where(m.merge_keys[at] == key, m.merge_ranks[at], 1 << 61)
            # of equal merges the left one goes first
            over = (rank < next_u[live]) & (rank <= next_v[live])
            out[live[over]] = False
            ra, rb = m.rank[a], m.rank[b]
            going = ~over & ((ra >= 0) | (rb >= 0))
            back_a = going & (ra > rb)
            back_b = going & ~back_a
            next_u[live[back_a]], u[live[back_a]] = ra[back_a], m.right[a[back_a]]
            next_v[live[back_b]], v[live[back_b]] = rb[back_b], m.left[b[back_b]]
            live = live[going]
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids; the space before the first piece goes, bytes that are no UTF-8 become U+FFFD."""
        lengths = self.out_lengths[ids]
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        data = self.out_bytes[np.repeat(self.out_starts[ids], lengths) + within].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        texts = [data[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [x[1:] if x[:1] == " " else x for x in texts]


def suffix_array(packed: np.ndarray, n: int, words: int) -> np.ndarray:
    """Starts of the suffixes of the first n bytes, sorted by their first 8 * words bytes or more; packed: the 8 bytes from each byte on, high byte first."""
    array = np.argsort(packed[:n], kind="stable")
    reach = 8
    while True:
        ordered = packed[:n][array] if reach == 8 else pair[array]  # noqa: F821
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.zeros(n + reach, np.int64)
        rank[array] = new + 1
        if reach >= 8 * words or new[-1] == n - 1:
            return array
        pair = rank[:n] * (n + 2) + rank[reach : reach + n]
        array = np.argsort(pair, kind="stable")
        reach *= 2


def codec(model: bytes) -> Codec:
    if (key := f"sentencepiece {zlib.crc32(model)} {len(model)}") not in _loaded:
        _loaded[key] = Codec(load(model))
    return _loaded[key]


def encode(df: DataFrame, model: bytes, text: str = "text", ids: bool = True, check: bool = False, part_bytes: int = 2 << 20) -> DataFrame:
    """df with ids (array<int>, as the sentencepiece library encodes each whole text), n_tokens (long) and ids_crc32 (long: of the ids as little-endian unsigned 32-bit integers).

    ids=False leaves the ids out; check=True adds round_trip: whether decoding them gives the text back (U+2581 comes
    back as a space). Null and empty texts have no ids (0, crc 0, true). Characters that the model doesn't know become
    their bytes' pieces. Repeated rows are encoded each, an empty table stays empty. Columns named like the new ones
    are replaced.
    """
    new = ({"ids": "array<int>"} if ids else {}) | {"n_tokens": "long", "ids_crc32": "long"} | ({"round_trip": "boolean"} if check else {})
    keep = [c for c in df.columns if c not in new]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model)
        for batch in batches:
            for lo, hi in slices(batch.column(text), part_bytes):
                part = batch.slice(lo, hi - lo)
                starts, lengths, bounds = made.of(part.column(text))
                found = gathered(made.ids, starts, lengths)
                n_tokens = sums(lengths, bounds)
                ends = np.concatenate([[0], np.cumsum(n_tokens)])
                view = memoryview(found.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [part.column(c) for c in keep]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.astype(np.int32))))
                columns += [pa.array(n_tokens), pa.array(crc, pa.int64())]
                if check:
                    columns.append(pa.array([a == (b or "").replace(SPACE, " ") for a, b in zip(made.decode(found, ends), part.column(text).to_pylist(), strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *new])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} {t}" for c, t in new.items())])
    return df.select(*(f"`{c}`" for c in keep)).mapInArrow(encoded, schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of each list of ids in column `to`; a null or empty list gives an empty text."""
    keep = [c for c in df.columns if c != to]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model)
        for batch in batches:
            lists = batch.column(ids)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            for lo in range(0, len(lengths), 512):
                part = batch.slice(lo, 512)
                flat = np.asarray(pc.list_flatten(part.column(ids)), np.int64)
                texts = made.decode(flat, np.concatenate([[0], np.cumsum(lengths[lo : lo + 512])]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, to])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{to}` string"])
    return df.mapInArrow(decoded, schema)
