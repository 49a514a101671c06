"""Line dedup and the Jaccard join against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from basalt.llm import common, jaccard_join, line_dedup


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def joined(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        x, y = sorted((find(parent, a), find(parent, b)))
        parent[y] = x
    return {i: find(parent, i) for i in ids}


def near_copies(prose, n=200, seed=3):
    """Texts with copies, copies of copies with ever more changes, and a passage that many share."""
    rng = random.Random(seed)
    rows = []
    shared = prose(777, 40)
    while len(rows) < n:
        k = len(rows)
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(["changed", "words", "here"])
            rows.append((k, " ".join(words)))
        else:
            rows.append((k, prose(k, rng.choice([3, 5, 30, 80, 150])) + (" " + shared if rng.random() < 0.4 else "")))
    return rows


def sets(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def expected(rows):
    own = {i: sets(t) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(own, 2) if own[a] and own[b] and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    return {i: (len(own[i]), c) for i, c in joined(own, links).items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_are_those_of_all_pairs(spark, prose, seed):
    rows = near_copies(prose, 250, seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert found == expected(rows)


def test_one_large_group_of_near_copies(spark, prose):
    rng = random.Random(6)
    base = prose(1, 120).split(" ")
    rows = []
    for k in range(150):
        words = [*base]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()} == expected(rows)


def test_jaccard_of_odd_rows(spark, odd, odd_rows, none):
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd.withColumn("node", F.lit(1)).withColumn("n", F.lit(2))).collect()), key=repr)
    want = expected([(i, t) for i, t, *_ in odd_rows])
    rows = [(i, *want[i]) if i is not None else (None, len(sets(t)), None) for i, t, *_ in odd_rows]
    assert found == sorted(rows, key=repr)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(5, 5), (200, 201)]
    found = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 30)}, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_leaves_exactly_the_others(spark):
    df = spark.createDataFrame([(k if k % 7 else None, str(k)) for k in range(500)], "doc_id long, text string")
    ids = spark.range(0, 500, 3).withColumnRenamed("id", "doc_id")
    assert sorted(r.text for r in common.without(df, ids, "doc_id").collect()) == sorted(r.text for r in df.join(ids, "doc_id", "left_anti").collect())


# --- lines ---


def norm(line):
    return [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", line.lower()) if w]


def levenshtein(a, b):
    line = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, line[j] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def lines_table(prose, seed=2):
    rng = random.Random(seed)
    pool = [prose(k, rng.choice([2, 6, 20, 40])).replace("\n", " ") for k in range(60)]
    rows = []
    for k in range(60):
        own = []
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(pool) if rng.random() < 0.7 else prose(1000 + rng.randrange(10**6), 25).replace("\n", " ")
            words = line.split(" ")
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] += rng.choice(["s", "!", " 17", "x"])
            own.append(" ".join(words))
        rows.append((k, "\n".join([*own, "", "}", "x"])))
    return rows


def test_fuzzy_lines_are_those_of_all_pairs(spark, prose):
    rows = lines_table(prose)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    sims = {r.id: (r.sim & (2**64 - 1), norm(texts[r.doc_id].split("\n")[r.line])) for r in line_dedup.occurrences(df).collect()}
    links = []
    for a, b in itertools.combinations(sims, 2):
        (p, x), (q, y) = sims[a], sims[b]
        if (p ^ q).bit_count() <= line_dedup.DISTANCE and levenshtein(x, y) <= int(max(len(x), len(y)) * (1 - line_dedup.SIMILAR) + 1e-9):
            links.append((a, b))
    assert links
    groups = joined(sims, links)
    found = line_dedup.groups(df).collect()
    mine, theirs = {}, {}
    for r in found:
        mine.setdefault(r.root, set()).add(r.id)
    for i, root in groups.items():
        theirs.setdefault(root, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    first = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.line)):
        assert r.kept == (r.root not in first)
        first.setdefault(r.root, r)


def test_simhash_counts_bits(spark):
    words = ["one", "two", "three", "two", "four", "five"]
    hashed = [r.h & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in {*words}], "w string").selectExpr("xxhash64(w) as h").collect()]
    wanted = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))
    found = spark.range(1).select(line_dedup.simhash(F.array(*map(F.lit, words)))).first()[0]
    assert found & (2**64 - 1) == wanted


def test_texts_lose_repeated_lines(spark, prose):
    a, b, c = (prose(k, 30).replace("\n", " ") for k in (1, 2, 3))
    rows = [(1, f"{a}\n{b}\n{a}", "x"), (2, f"{a.upper()}\n{b}", "y"), (3, f"{c}\n\n}}\n{b}", None), (4, None, None), (5, "", None), (6, "}\n}", None), (None, a, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert found == {1: (f"{a}\n{b}", 3, 1), 2: ("", 2, 2), 3: (f"{c}\n\n}}", 4, 1), 4: (None, 0, 0), 5: ("", 1, 0), 6: ("}\n}", 2, 0), None: (a, 1, 0)}
    assert {r.doc_id for r in line_dedup.dedup_lines(df, drop_emptied=True).collect()} == {1, 3, 4, 5, 6, None}


def test_lines_of_odd_rows(spark, odd, odd_rows, none):
    found = line_dedup.line_counts(odd.withColumn("line", F.lit(1)).withColumn("sim", F.lit(1))).collect()
    assert len(found) == len(odd_rows)
    assert {r.doc_id: r.n_removed for r in found}[7] == {r.doc_id: r.n_lines for r in found}[7]  # a copy of document 6
    assert {r.n_removed for r in found if r.doc_id == 6} == {0}
    assert line_dedup.line_counts(none).count() == 0 and line_dedup.dedup_lines(none).count() == 0
