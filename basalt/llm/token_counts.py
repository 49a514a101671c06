"""Token counts of whole texts, batch-encoded in an Arrow function that returns lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from basalt.llm.common import slices

#: Pieces that a Python worker remembers, about 200 bytes each; beyond, it forgets those met in one call only.
REMEMBERED = 3 << 18
#: Bytes of unseen pieces in one call of the tokenizer.
CALL_BYTES = 1 << 20
#: Unseen words laid side by side in one text of such a call.
LINE = 24

#: A space before a character that isn't white space: no pre-token of byte-level BPE reaches over it, whatever stands before.
SAFE = re.compile(r"(?<=\S)(?= \S)")
#: A space before white space: such texts are cut with SAFE, all others at every space.
IRREGULAR = r" [\x00-\x20\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
    return _loaded[path]


def balanced(run: list[str], most: int = CALL_BYTES) -> Iterator[tuple[list[str], np.ndarray]]:
    """run in parts of about `most` bytes, with the bytes of each text."""
    sizes = np.asarray(pc.binary_length(pa.array(run, pa.large_string())), np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(run)], strict=True):
        if hi > lo:
            yield run[lo:hi], sizes[lo:hi]


class Memory:
    """Token ids of the pieces of texts that a worker has met, each encoded once while it is remembered.

    Subclasses say where texts are cut and encode what is unseen. Texts that match `irregular` are cut by `cut`, all
    others before every space.
    """

    irregular = IRREGULAR
    #: The first piece of a text has a space before it, too.
    prefix = False

    def __init__(self, limit: int = REMEMBERED):
        self.limit = limit
        self._anew()

    def cut(self, text: str) -> list[str]:
        return SAFE.split(text)

    def _anew(self) -> None:
        #: Of words behind a space, without it, and of other pieces.
        self.index: dict[str, int] = {}
        self.apart: dict[str, int] = {}
        self.n, self.ids = 0, np.zeros(1 << 16, np.uint32)
        self.starts, self.met = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint8)

    def _forget(self) -> None:
        """Keeps what was met in several calls; nothing if that is more than half of the limit."""
        kept = [(x, i) for x, i in self.index.items() if self.met[i] > 1]
        old = self.ids, self.starts
        self._anew()
        if kept and len(kept) <= self.limit // 2:
            at = np.array([i for _, i in kept])
            lengths = old[1][at + 1] - old[1][at]
            ids = old[0][np.repeat(old[1][at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
            self._add(self.index, [x for x, _ in kept], ids, lengths)

    def _add(self, to: dict[str, int], run: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        at = self.starts[self.n]
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(at + 2 * len(ids), 1 << 16), np.uint32)])
        if self.n + len(run) + 1 > len(self.starts):
            more = self.n + 2 * len(run)
            self.starts, self.met = np.concatenate([self.starts[: self.n + 1], np.zeros(more, np.int64)]), np.concatenate([self.met[: self.n + 1], np.zeros(more, np.uint8)])
        self.ids[at : at + len(ids)] = ids
        self.starts[self.n + 1 : self.n + 1 + len(run)] = at + np.cumsum(lengths)
        to.update(zip(run, range(self.n, self.n + len(run)), strict=True))
        self.n += len(run)

    def _known(self, words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The index of each of `words`, distinct, behind a space, and of each of the other pieces; what is unseen is learned first."""
        found = self.index.get
        at = np.array([found(x, -1) for x in words], np.int64)
        new, apart = np.flatnonzero(at < 0), {x for x in others if x not in self.apart}
        if self.n + len(new) + len(apart) > self.limit:
            self._forget()
            found = self.index.get
            at = np.array([found(x, -1) for x in words], np.int64)
            new, apart = np.flatnonzero(at < 0), {*others}
        if len(new):
            # a lone space isn't laid beside others
            self._learn([words[i] for i in new if words[i]])
            if "" not in self.index and any(not words[i] for i in new):
                self._each(self.index, [""], [" "])
            found = self.index.get
            at[new] = [found(words[i]) for i in new]
        if apart:
            self._each(self.apart, [*apart], [*apart])
        self.met[at] = np.minimum(self.met[at], 254) + 1
        return at, np.fromiter(map(self.apart.__getitem__, others), np.int64, len(others))

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all pieces of the texts: where their ids start in self.ids, how many, and the first piece of each text, with the total last."""
        column = pc.fill_null(column, "")
        odd = np.asarray(pc.match_substring_regex(column, self.irregular))
        plain = column.filter(pa.array(~odd)) if odd.any() else column
        words = pc.split_pattern(plain, " ")
        counts = np.asarray(pc.list_value_length(words), np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        word = np.asarray(coded.indices, np.int64)
        first = (np.cumsum(counts) - counts)[counts > 0] if not self.prefix else np.zeros(0, np.int64)
        odd_pieces = [self.cut(x) for x in column.filter(pa.array(odd)).to_pylist()] if odd.any() else []
        first_pieces = coded.dictionary.take(pa.array(word[first])).to_pylist()
        known, others = self._known(coded.dictionary.to_pylist(), [*first_pieces, *(x for text in odd_pieces for x in text)])
        at = known[word]
        at[first] = others[: len(first)]
        if odd_pieces:
            n_odd = np.array([*map(len, odd_pieces)])
            at = np.concatenate([at, others[len(first) :]])
            row = np.concatenate([np.repeat(np.flatnonzero(~odd), counts), np.repeat(np.flatnonzero(odd), n_odd)])
            at, counts = at[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(column))
        return self.starts[at], self.starts[at + 1] - self.starts[at], np.concatenate([[0], np.cumsum(counts)])


class Pieces(Memory):
    """Pieces of byte-level BPE, encoded by the tokenizers library.

    Unseen words behind a space are encoded LINE to a text, and cut again where the bytes of their
    tokens have come to the bytes of the piece. A run whose tokens don't add up so is encoded piece by piece.
    """

    def __init__(self, path: str, limit: int = REMEMBERED):
        super().__init__(limit)
        self.made = tokenizer(path)
        vocabulary = self.made.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max([*vocabulary.values(), *self.made.get_added_tokens_decoder()], default=0) + 1, np.int64)
        for token, i in vocabulary.items():  # byte level: one character for each byte
            self.n_bytes[i] = len(token)
        for i, token in self.made.get_added_tokens_decoder().items():
            self.n_bytes[i] = len(token.content.encode())

    def _learn(self, words: list[str]) -> None:
        for run, sizes in balanced(words):
            texts = [" " + " ".join(run[k : k + LINE]) for k in range(0, len(run), LINE)]
            found = self.made.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32)
            ends = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
            wanted = np.concatenate([[0], np.cumsum(sizes + 1)])
            cut = np.searchsorted(ends, wanted)
            if ends[-1] == wanted[-1] and np.array_equal(ends[cut], wanted):
                self._add(self.index, run, ids, np.diff(cut))
            else:
                self._each(self.index, run, [" " + x for x in run])

    def _each(self, to: dict[str, int], names: list[str], run: list[str]) -> None:
        at = 0
        for part, _ in balanced(run):
            ids = [x.ids for x in self.made.encode_batch_fast(part, add_special_tokens=False)]
            self._add(to, names[at : at + len(part)], np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))
            at += len(part)


def piece_memory(path: str) -> Pieces:
    if (key := f"pieces {path}") not in _loaded:
        _loaded[key] = Pieces(path)
    return _loaded[key]


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of all runs in a row."""
    if not lengths.all():
        starts, lengths = starts[lengths > 0], lengths[lengths > 0]
    if not len(starts):
        return values[:0]
    ends = np.cumsum(lengths)
    steps = np.ones(ends[-1], np.int32)
    steps[0] = starts[0]
    steps[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return values[np.cumsum(steps, out=steps)]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 512, call_bytes: int = 8 << 20) -> DataFrame:
    """df's columns but the text, with n_bytes, n_tokens (long) and over_limit (n_tokens > limit).

    The counts are those that the tokenizers library gives for each whole text without begin, end or added special
    tokens; special strings inside a text count as its default has them. Texts, however long, are cut at safe
    boundaries into pieces; the distinct pieces of a batch go to the tokenizer in runs of about CALL_BYTES and only
    their lengths come back. Null and empty texts: 0, 0, false. Repeated rows are counted each; an empty table gives
    an empty table. Columns named like the new ones are replaced.
    """
    new = [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")]
    keep = [c for c in df.columns if c != text and c not in dict(new)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = piece_memory(path)
        for batch in batches:
            tokens = [np.zeros(0, np.int64)]
            for lo, hi in slices(batch.column(text), call_bytes):
                _, lengths, bounds = seen.of(batch.column(text).slice(lo, hi - lo))
                tokens.append(sums(lengths, bounds))
            tokens = np.concatenate(tokens)
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(batch.column(text)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), n_bytes, pa.array(tokens), pa.array(tokens > limit)], names=[*keep, *dict(new)])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} {t}" for c, t in new)])
    return df.select(*(f"`{c}`" for c in keep), text).mapInArrow(counted, schema)
