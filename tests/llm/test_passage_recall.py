"""Decontamination's recall by length of item, and passages behind their own first words."""

import random

import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import decontamination
from test_texts import edited


def searched(items, texts):
    """{(row, item): (start_word, edits)} of the candidates that hold their item, the fewest edits and then the first start."""
    hashes = decontamination.Hashes([*range(len(items))], [" ".join(x) for x in items])
    hashed, bounds = decontamination.words(pa.array([" ".join(x) for x in texts]))
    text, sizes = np.insert(hashes.symbols(hashed), bounds[1:], 1), np.diff(bounds) + 1
    row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - 1
    starts, item = hashes.candidates(text, ends[row])
    ok, edits, _ = hashes.verified(text, ends[row], starts, item)
    found = {}
    for e, s, i in sorted(zip(edits[ok].tolist(), starts[ok].tolist(), item[ok].tolist(), strict=True)):
        found.setdefault((int(row[s]), i), (int(s - ends[row[s]] - 1 + sizes[row[s]]), e))
    return found


def drawn(rng, n, of=3000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
@pytest.mark.parametrize("n", [15, 40, 100, 200, 400])
def test_recall_at_every_length_and_distance(n, share):
    rng = random.Random(n)
    pool = [f"w{k}" for k in range(3000)]
    items = [drawn(rng, n) for _ in range(20)]
    found = searched(items, [drawn(rng, 60) + edited(rng, x, int(share * n + 1e-9), pool) + drawn(rng, 60) for x in items])
    assert sum((k, k) in found for k in range(20)) >= (20 if not share else 18)


@pytest.mark.parametrize("n", [5, 7, 9, 15])
@pytest.mark.parametrize("head", [1, 2, 3, 4])
def test_passages_behind_their_own_first_words(n, head):
    rng = random.Random(9)
    items = [[f"i{k}x{j}" for j in range(n)] for k in range(3)]
    texts = [drawn(rng, 40) + x[:head] + x + drawn(rng, 400) for x in items]
    assert searched(items, texts) == {(k, k): (40 + head, 0) for k in range(3)}
