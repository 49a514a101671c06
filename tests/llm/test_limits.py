"""Inputs beyond what operators once cut off: long names, short templates and items, many repeats of one notice."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basalt.llm import common, decontamination, license_scan, line_dedup, url_filters


def test_words_of_names_of_any_length():
    model = url_filters.train()
    name = "q" * 251 + "casinocasino" + "z" * 3000
    assert url_filters.split_words(name, model) == ["q" * 251, "casino", "casino", "z" * 3000]


@pytest.mark.parametrize("text", ["wtfpl", "foo public terms", "public terms"])
def test_short_templates_and_phrases_are_found(text):
    as_template = license_scan.Scanner((("x", text), *license_scan.TEMPLATES), {})
    as_phrase = license_scan.Scanner(license_scan.TEMPLATES, {text: "w"})
    column = pa.array([f"some words {text} and others", text, "nothing", None, f"{text} {text}"])
    at = [[2], [0], [], [], [0, len(text.split())]]
    assert [[(a, b, c) for label, a, b, c in spans if label == "x"] for _, _, spans in as_template.scan(column)] == [[(k, k + len(text.split()) - 1, 1.0) for k in x] for x in at]
    assert [sorted(k for k, label in places if label == "w") for _, places, _ in as_phrase.scan(column)] == at


def test_repeats_of_a_notice_are_chained_in_linear_time():
    scanner = license_scan.Scanner()
    notice = license_scan.TEMPLATES[1][1]
    began = time.perf_counter()
    ((n, _, spans),) = scanner.scan(pa.array([f"{notice} " * 20_000]))
    assert time.perf_counter() - began < 60
    assert n == 100_000 and sum(label == "mit" and c == 1 for label, _, _, c in spans) >= 20_000


def test_matching_statistics_are_the_longest_runs_that_templates_hold():
    rng = random.Random(8)
    texts = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    automaton = license_scan.Automaton(texts)
    runs = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    words = [rng.randrange(5) for _ in range(300)]
    for k, (v, length) in enumerate(automaton.statistics(words)):
        want = max((n for n in range(k + 2) if not n or tuple(words[k + 1 - n : k + 1]) in runs), default=0)
        assert length == want
        if length:
            run = words[k + 1 - length : k + 1]
            assert {x for x in automaton.ends[v]} == {(i, j) for i, t in enumerate(texts) for j in range(length - 1, len(t)) if t[j + 1 - length : j + 1] == run}


def test_items_of_fewer_words_than_the_walk_needs_are_found_exactly(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two ONE two"), (3, "one, two"), (4, None), (5, "two three one")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "One two"), (8, "three"), (9, "one two three four"), (10, ""), (11, "...")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.edits) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(1, 7, 0, 2, 0), (1, 8, 2, 1, 0), (2, 7, 1, 2, 0), (3, 7, 0, 2, 0), (5, 8, 1, 1, 0)}


def test_short_runs_of_all_lengths_against_brute_force():
    rng = random.Random(3)
    items = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (1, 2, 3, 4) for _ in range(3)]
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    hashes = decontamination.Hashes([*range(len(items))], items)
    hashed, bounds = decontamination.words(pa.array(texts))
    text, sizes = np.insert(hashes.symbols(hashed), bounds[1:], 1), np.diff(bounds) + 1
    row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - 1
    starts, item = hashes.candidates(text, ends[row])
    found = {(int(row[s]), int(s - ends[row[s]] - 1 + sizes[row[s]]), int(i)) for s, i in zip(starts, item, strict=True)}
    want = {(r, k, i) for r, t in enumerate(texts) for i, x in enumerate(items) for k in range(len(t.split())) if t.split()[k : k + len(x.split())] == x.split()}
    assert found == want


def test_rows_that_share_a_doc_id_but_no_text_lose_their_own_lines(spark):
    rows = [(1, "alpha"), (5, "alpha\nbeta"), (5, "gamma\ndelta"), (5, "gamma\ndelta"), (6, "delta")]
    found = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(1, "alpha"), (5, "beta"), (5, "gamma\ndelta"), (5, "gamma\ndelta"), (6, "")]


def test_sketches_of_an_aggregation_are_those_of_the_function(spark):
    rng = random.Random(1)
    rows = [(k, [f"w{rng.randrange(200)}" for _ in range(n)]) for k, n in enumerate([1, 2, 5, 60, 63, 64, 65, 300])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    both = line_dedup.sketched(df).join(df.select("id", line_dedup.simhash(F.col("words")).alias("own"), F.size("words").alias("n")), "id").collect()
    assert len(both) == len(rows) and all(r.sim == r.own and len(r.code) == r.n for r in both)


def test_crowded_blocks_lose_no_near_line(spark):
    """A passage that 300 lines share makes its blocks crowded; near lines among them are still found."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(12)]
    rows = [" ".join([*(word() for _ in range(14)), *passage, *(word() for _ in range(14))]) for _ in range(300)]
    near = []
    for line in rows[:40]:
        words = line.split()
        for k in rng.sample(range(40), 4):
            words[k] = word()
        near.append(" ".join(words))
    found = {r.doc_id: r.root for r in line_dedup.groups(spark.createDataFrame([*enumerate(rows + near)], "doc_id long, text string")).collect()}
    assert sum(found[k] == found[300 + k] for k in range(40)) >= 38
    assert len({found[k] for k in range(300)}) == 300


@pytest.mark.parametrize("crowd", [2, 64])
def test_lines_that_share_only_a_crowded_block_are_all_linked(spark, monkeypatch, crowd):
    """300 lines of seven words begin alike and 60 of them have a near line that shares no other block: both ways, each with each and split."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    pool = [word() for _ in range(40)]
    rows = [f"we use cookies to {' '.join(rng.sample(pool, 3))}" for _ in range(300)]
    rows += [" ".join([*line.split()[:5], word(), *line.split()[6:]]) for line in rows[:60]]
    found = {r.doc_id: r.root for r in line_dedup.groups(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()}
    split = [line.split() for line in rows]
    sims = {r.doc_id: r.sim for r in line_dedup.occurrences(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()}
    near = lambda a, b: sum(x != y for x, y in zip(split[a], split[b], strict=True)) <= 1 and ((sims[a] ^ sims[b]) & (2**64 - 1)).bit_count() <= line_dedup.DISTANCE
    links = [(a, b) for a in range(360) for b in range(a) if near(a, b)]
    assert len(links) >= 60 and all(found[a] == found[b] for a, b in links)
    group = {k: k for k in range(360)}
    for _ in range(20):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert len({*found.values()}) == len({*group.values()})


def test_filters_beyond_their_ids_let_all_rows_join(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_IDS", 10)
    df, ids = spark.range(200).withColumnRenamed("id", "doc_id"), spark.range(0, 200, 3).withColumnRenamed("id", "doc_id")
    assert common.without(df, ids, "doc_id").count() == 133 and common.joinable(df, ids, "doc_id").count() == 200


def test_lines_that_share_only_a_passage_are_no_pairs(spark, monkeypatch):
    """What is compared by edits grows with the near lines, not with the square of the lines that share a passage."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(20)]
    rows = [" ".join([*(word() for _ in range(10)), *passage, *(word() for _ in range(10))]) for _ in range(200)]
    rows += [" ".join([*line.split()[:3], word(), *line.split()[4:37], word(), *line.split()[38:]]) for line in rows[:30]]
    compared, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, texts: compared.append(pairs.count()) or verified(pairs, texts))
    found = {r.doc_id: r.root for r in line_dedup.groups(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()}
    assert all(found[k] == found[200 + k] for k in range(30)) and len({*found.values()}) == 200
    # one for each line with its leader, then near lines
    assert sum(compared) <= 230 + 60


def test_crowded_blocks_are_split_in_proportion_to_their_lines(spark, monkeypatch):
    """Lines of one passage and of words that many others have stay crowded in every split: rows are as many as a line's edits and one for each, and near lines are found."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage, pool = [word() for _ in range(24)], [word() for _ in range(40)]
    rows = [" ".join([*rng.sample(pool, 8), *passage, *rng.sample(pool, 8)]) for _ in range(200)]
    rows += [" ".join([*line.split()[:3], word(), *line.split()[4:36], word(), *line.split()[37:]]) for line in rows[:30]]
    made, stored = [], common.stored
    monkeypatch.setattr(line_dedup, "CROWD", 2)
    monkeypatch.setattr(common, "stored", lambda df: _counted(stored(df), made))
    found = {r.doc_id: r.root for r in line_dedup.groups(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()}
    assert all(found[k] == found[200 + k] for k in range(30))
    # lines of 40 words: 8 edits and one
    assert max(made) <= 230 * 9


def _counted(df, made):
    if "at" in df.columns:
        made.append(df.count())
    return df
