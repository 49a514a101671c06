"""License scans: matching statistics of texts against a generalised suffix automaton of licence templates.

The automaton holds every run of words of every template. Streaming a text through it gives, at each word, the longest
run that ends there and stands in a template. Runs that can't grow are matches; long ones of one template that follow
each other in the text as in the template are chained into a span, whose share of the template is its coverage.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basalt.llm import common

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as their licences word them, and usual short forms.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
)

#: Words of a match that chains, or a whole template's; words that may lie between matches of a chain; coverage for a label.
MATCH, GAP, COVERED = 4, 12, 0.6


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)


class Automaton:
    """Generalised suffix automaton over lists of word ids: one text after another is added from the root."""

    def __init__(self, texts: list[list[int]]):
        self.states = [State(0)]
        ends: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for number, text in enumerate(texts):
            last = 0
            for at, word in enumerate(text):
                last = self._extend(last, word)
                ends[last].add((number, at))
        #: (text, place of its last word) of every place where the runs of a state end
        self.ends = ends
        for v in sorted(range(1, len(self.states)), key=lambda v: -self.states[v].length):
            if self.states[v].link > 0:
                self.ends[self.states[v].link] |= self.ends[v]

    def _extend(self, last: int, word: int) -> int:
        states = self.states
        if word in states[last].next:
            there = states[last].next[word]
            return there if states[there].length == states[last].length + 1 else self._clone(last, word, there)
        new = len(states)
        states.append(State(states[last].length + 1))
        p = last
        while p >= 0 and word not in states[p].next:
            states[p].next[word] = new
            p = states[p].link
        if p < 0:
            states[new].link = 0
        else:
            q = states[p].next[word]
            states[new].link = q if states[q].length == states[p].length + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        states, copy = self.states, len(self.states)
        states.append(State(states[p].length + 1, states[q].link, dict(states[q].next)))
        states[q].link = copy
        while p >= 0 and states[p].next.get(word) == q:
            states[p].next[word] = copy
            p = states[p].link
        return copy

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """At each word the state and length of the longest run ending there."""
        v, length, states = 0, 0, self.states
        for word in words:
            while v and word not in states[v].next:
                v = states[v].link
                length = states[v].length
            if word in states[v].next:
                v, length = states[v].next[word], length + 1
            yield v, length

    def ancestors(self, v: int) -> Iterator[int]:
        while v > 0:
            yield v
            v = self.states[v].link


class Scanner:
    def __init__(self, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES):
        texts = [x for _, x in templates] + [*phrases]
        data, offsets = common.utf8(pa.array(texts, pa.string()))
        data = common.LOWER[data]
        starts, ends, bounds = common.spans(data, offsets, common.ALNUM)
        hashed = common.span_hashes(data, starts, ends)
        self.vocabulary = np.unique(hashed)
        ids = np.searchsorted(self.vocabulary, hashed)
        lists = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.labels = [x for x, _ in templates]
        self.lengths = [len(x) for x in lists[: len(templates)]]
        self.automaton = Automaton(lists)
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        size = len(self.vocabulary)
        self.follows = np.zeros((size + 1) * (size + 1), bool)
        #: What a phrase or a template of fewer than MATCH words begins with: its first two words, or its only one.
        self.opens = np.zeros((size + 1) * (size + 1), bool)
        self.alone = np.zeros(size + 1, bool)
        for k, x in enumerate(lists):
            at = np.array(x[:-1], np.int64) * (size + 1) + np.array(x[1:], np.int64)
            self.follows[at] = True
            if k >= len(templates) or len(x) < MATCH:
                self.opens[at[:1]] = True
                self.alone[x[:1] if len(x) == 1 else []] = True
        #: By state: (words, label, whether the state is the phrase's own) of the base phrases that its longest run ends with.
        own = {}
        for x, label in zip(lists[len(templates) :], phrases.values(), strict=True):
            v = 0
            for word in x:
                v = self.automaton.states[v].next[word]
            own.setdefault(v, []).append((len(x), label))
        self.phrases = {v: [(n, label) for a in self.automaton.ancestors(v) for n, label in own.get(a, [])] for v in range(len(self.automaton.states))}

    def ids(self, hashed: np.ndarray) -> np.ndarray:
        out = np.full(len(hashed), len(self.vocabulary), np.int64)
        maybe = np.flatnonzero(self.near[(hashed & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashed[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashed[maybe], at, len(self.vocabulary))
        return out

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]]:
        """Per row: its words, the places (first word, label) of base phrases, and spans (label, first word, last word, coverage)."""
        for lo, hi in common.slices(column):
            data, offsets = common.utf8(column.slice(lo, hi - lo))
            data = common.LOWER[data]
            starts, ends, bounds = common.spans(data, offsets, common.ALNUM)
            ids = self.ids(common.span_hashes(data, starts, ends))
            pairs = ids[:-1] * (len(self.vocabulary) + 1) + ids[1:]
            on = self.follows[pairs]
            inner = bounds[1:-1]
            on[inner[(inner > 0) & (inner < len(ids))] - 1] = False
            # runs of words that follow each other in a template, and known words by themselves
            known = ids < len(self.vocabulary)
            linked = np.concatenate([[False], on, [False]]) if len(ids) else np.zeros(1, bool)
            first, last = np.flatnonzero(known & ~linked[:-1]), np.flatnonzero(known & ~linked[1:])
            marks = self.alone[ids]
            marks[:-1] |= self.opens[pairs] & on
            begun = np.concatenate([[0], np.cumsum(marks)])
            kept = (last - first + 1 >= MATCH) | (begun[last + 1] > begun[first])
            places, spans = defaultdict(list), defaultdict(list)
            row = np.searchsorted(bounds, first[kept], side="right") - 1
            for r, a, b in zip(row.tolist(), first[kept].tolist(), (last[kept] + 1).tolist(), strict=True):
                self._run(ids[a:b].tolist(), a - int(bounds[r]), places[r], spans[r])
            for r, n in enumerate(np.diff(bounds).tolist()):
                yield n, places.get(r, []), self._chained(spans[r]) if r in spans else []

    def _run(self, words: list[int], at: int, places: list, matches: list) -> None:
        """Adds the run's base phrases, and its maximal matches as (first word, words, state)."""
        before = (0, 0)
        for k, (v, length) in enumerate([*self.automaton.statistics(words), (0, 0)]):
            for n, label in self.phrases[v]:
                if length >= n:
                    places.append((at + k - n + 1, label))
            if before[1] and length != before[1] + 1:
                matches.append((at + k - before[1], before[1], before[0]))
            before = v, length

    def _chained(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans of templates: matches in the text's order, each extending the open chain of its template that it fits."""
        chains: dict[int, list[list[int]]] = defaultdict(list)  # open ones: [first word, end in text, end in template, covered]
        closed: list[tuple[int, list[int]]] = []
        for first, length, state in sorted(matches):
            best: dict[int, tuple] = {}
            for number, end in self.automaton.ends[state]:
                if number >= len(self.lengths) or length < min(MATCH, self.lengths[number]):
                    continue
                begin = end - length + 1
                if any(chain[1] + GAP < first for chain in chains[number]):  # what nothing can extend any more
                    closed += [(number, chain) for chain in chains[number] if chain[1] + GAP < first]
                    chains[number] = [chain for chain in chains[number] if chain[1] + GAP >= first]
                for chain in chains[number]:
                    over = max(0, chain[1] - first, chain[2] - begin)
                    if chain[1] - GAP * 2 < first <= chain[1] + GAP and chain[2] - GAP < begin <= chain[2] + GAP and over < length:
                        best[number] = max(best.get(number, (0, 0, None, 0)), (chain[3] + length - over, -chain[0], chain, end + 1), key=lambda x: x[:2])
                if number not in best:
                    best[number] = (length, 0, None, end + 1)
            for number, (covered, _, chain, end) in best.items():
                if chain is None:
                    chains[number].append([first, first + length, end, covered])
                else:
                    chain[1:] = [first + length, end, covered]
        closed += [(n, chain) for n, some in chains.items() for chain in some]
        return [(self.labels[n], c[0], c[1] - 1, min(1.0, c[3] / self.lengths[n])) for n, c in closed]


def scan(df: DataFrame, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES, text: str = "text") -> DataFrame:
    """df without the text, with n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double) and spans.

    Words are runs of digits, a-z and non-ASCII characters, A-Z lower-cased. n_base counts all places of base phrases;
    first_word and last_word are the smallest and largest word they start at, null without any. labels adds the
    templates' that a span covers by COVERED or more; both are distinct, sorted and comma-joined, empty without any.
    score is the largest coverage, 1 with a base phrase. spans lists (label, first, last, coverage) of all chains,
    places of words. Null and empty texts have no words. Repeated rows are scanned each; an empty table stays empty.
    """
    new = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double", "spans": "array<struct<label:string,first:long,last:long,coverage:double>>"}
    keep = [c for c in df.columns if c != text and c not in new]
    scanner = Scanner(templates, phrases)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))
        for batch in batches:
            rows = []
            for n, places, spans in scanner.scan(batch.column(text)):
                base = {x for _, x in places}
                at = [x for x, _ in places]
                labels = base | {x for x, _, _, c in spans if c >= COVERED}
                score = 1.0 if base else max((c for *_, c in spans), default=0.0)
                rows.append((n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"label": a, "first": b, "last": c, "coverage": d} for a, b, c, d in sorted(spans)]))
            columns = [*zip(*rows, strict=True)] or [[]] * len(new)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([*x], k) for x, k in zip(columns, kinds, strict=True))], names=[*keep, *new])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} {t}" for c, t in new.items())])
    return df.select(*(f"`{c}`" for c in keep), text).mapInArrow(scanned, schema)
