"""Quality rules and classifier, url filters, licence scans and decontamination, against brute force and planted cases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basalt.llm import decontamination, license_scan, quality_classifier, quality_rules, url_filters

# --- quality rules ---


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len({*lines}), len(repeated), failed


def test_base_rules(spark, odd, odd_rows, none, prose):
    more = [(20, "a b c d e f\na b c d e f\n\n a b c d e f", "en", "s", 1), (21, "# $ x|y <b> " * 3, "en", "s", 1), (22, prose(1, 40) + " " + prose(1, 40), "en", "s", 1), (23, "a a a a a a a a a a a", "en", "s", 1)]
    df = odd.unionByName(spark.createDataFrame(more, odd.schema)).withColumn("w", F.lit(1)).withColumn("kept", F.lit("x"))
    found = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(df).collect())
    assert found == sorted((i or 0, *base(t)) for i, t, *_ in [*odd_rows, *more])
    assert quality_rules.judge(none).count() == 0


def test_divergent_texts_are_rejected(spark, prose):
    good = [(k, prose(k, 120), "en") for k in range(40)]
    junk = [(100, " ".join(w + "###" for w in prose(1, 120).split()), "en"), (101, "ABC DEF!! " * 3 + " ".join(f"{k:05d}" for k in range(100)), "en"), (102, " ".join(f"{k:05d}" for k in range(20)), "en")]
    found = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(good + junk, "doc_id long, text string, lang string")).collect()}
    assert all(found[k].kept for k in range(40))
    assert not found[100].kept and not found[101].kept
    assert found[102].kept and found[102].class_distance is None  # too short to tell


def test_distance_is_jensen_shannon(spark):
    p, q = [3, 0, 1, 6], [1, 1, 2, 0]
    a, b = np.array(p) / sum(p), np.array(q) / sum(q)
    kl = lambda x, y: sum(u * np.log2(u / v) for u, v in zip(x, y, strict=True) if u)
    wanted = np.sqrt((kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2)
    of = lambda x, y: quality_rules.distance(F.array(*map(F.lit, x)), F.array(*map(F.lit, y)))
    found = spark.range(1).select(of(p, q), of(p, p), of([1, 0], [0, 1]), of([0, 0], [0, 1])).first()
    assert found[0] == pytest.approx(wanted) and found[1] == pytest.approx(0) and found[2] == pytest.approx(1) and found[3] is None


# --- quality classifier ---


def test_classifier_learns_and_leaves_held_out_rows_alone(spark, prose, none):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        text = prose(k, 60)
        rows.append((k, text, 1) if k % 2 else (k, " ".join(w + rng.choice(["!!", "***", "###"]) for w in text.split()), 0))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(9999, 1), (None, 1), (5, None)], "doc_id long, quality int")
    weights = quality_classifier.train(docs, labels)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = {r.doc_id: r.predicted for r in quality_classifier.score(docs.where(held), weights).collect()}
    assert len(found) > 50 and np.mean([found[i] == y for i, _, y in rows if i in found]) > 0.95
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(weights, quality_classifier.train(docs, turned))
    assert not quality_classifier.train(docs, labels.limit(0)).any()
    assert quality_classifier.score(none, weights).count() == 0


def test_scores_of_odd_texts(spark, odd):
    weights = np.zeros(quality_classifier.BUCKETS + 1)
    weights[-1] = 1.0
    found = quality_classifier.score(odd.withColumn("score", F.lit("x")), weights).collect()
    assert len(found) == odd.count() and all(r.score == pytest.approx(1 / (1 + np.exp(-1))) and r.predicted == 1 for r in found)


def test_features_are_of_one_row(prose):
    both = [*quality_classifier.features(pa.array([prose(1, 50), "", None, prose(2, 50)]))][0]
    for k, text in enumerate([prose(1, 50), "", None, prose(2, 50)]):
        alone = [*quality_classifier.features(pa.array([text], pa.string()))][0]
        assert sorted(both[2][both[3][k] : both[3][k + 1]]) == sorted(alone[2])


# --- url filters ---


def test_rules(spark):
    urls = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://EXAMPLE.net/de/x?y=/en/#z": ("example.net", "/de/x", "net/", "block"),
        "https://notexample.net": ("notexample.net", "", None, "allow"),
        "https://x.example.com/de/": ("x.example.com", "/de/", "example.com/de/", "block"),
        "https://x.example.com/de": ("x.example.com", "/de", None, "allow"),
        "ftp://w.org/fr/a://b": ("w.org", "/fr/a://b", "org/fr/", "allow"),
        "no-scheme.net/": ("", "", None, "allow"),
        "https://cheappills.example.org/en/1?q#f": ("cheappills.example.org", "/en/1", None, "block"),
        "://h\u00c4.org#x": ("h\u00c4.org", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("path", F.lit("mine"))
    found = [tuple(r) for r in url_filters.judge(df).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert found == [*urls.values()]
    assert url_filters.judge(df.limit(0)).count() == 0


def test_names_are_split_at_the_likeliest_places():
    model = url_filters.train()
    assert url_filters.split_words("cheappills", model) == ["cheap", "pills"]
    assert url_filters.split_words("zqvcasinoqq", model) == ["zqv", "casino", "qq"]
    assert url_filters.split_words("", model) == []

    def best(name):  # over all splits
        if not name:
            return 0.0, []
        out = []
        for k in range(1, len(name) + 1):
            cost, rest = best(name[k:])
            own = model.costs.get(name[:k])
            if own is not None:
                out.append((own + cost, [name[:k], *rest]))
        return min(out, default=(1e9, []))

    for name in ("freecasino", "linkfarmspam", "onlinelibrary", "weatherreportdaily"):
        assert url_filters.split_words(name, model) == best(name)[1]


def test_naive_bayes_counts(spark):
    model = url_filters.train(["bad worse"], ["good"], prior=0.5)
    assert model.prior == 0 and model.odds["bad"] == pytest.approx(np.log((2 / 5) / (1 / 4)))
    assert url_filters.blocked_odds("bad.com", "/good", model) == pytest.approx(model.odds["bad"] + model.odds["good"])


# --- licence scans ---


def test_matching_statistics_are_the_longest_runs():
    rng = random.Random(4)
    texts = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    runs = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    made = license_scan.Automaton(texts)
    words = [rng.randrange(5) for _ in range(400)]
    for k, (v, length) in enumerate(made.statistics(words)):
        assert length == max((n for n in range(k + 2) if tuple(words[k + 1 - n : k + 1]) in runs), default=0) or length == 0
        if length:
            run = words[k + 1 - length : k + 1]
            assert made.ends[v] >= {(n, e) for n, e in made.ends[v] if texts[n][e + 1 - length : e + 1] == run} and all(texts[n][e + 1 - length : e + 1] == run for n, e in made.ends[v])


def phrase_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(k, label) for k in range(len(words)) for p, label in license_scan.PHRASES.items() if words[k : k + len(p.split())] == p.split()]
    first = [k for k, _ in at]
    return len(words), len(at), min(first, default=None), max(first, default=None), ",".join(sorted({x for _, x in at}))


def test_base_phrases(spark, odd, odd_rows, none):
    rng = random.Random(8)
    parts = ["CC", "by", "General", "Public-License", "all", "rights", "reserved.", "the", "license", "gnu", "cc by", "All Rights\nReserved", "é", "x1"]
    more = [(100 + k, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))), "en", "s", 1) for k in range(400)]
    df = odd.unionByName(spark.createDataFrame(more, odd.schema)).withColumn("score", F.lit("x"))
    found = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word if r.first_word is not None else -1, r.last_word if r.last_word is not None else -1, r.base_labels) for r in license_scan.scan(df).collect())
    fill = lambda p: (*p[:2], *(-1 if x is None else x for x in p[2:4]), p[4])
    assert found == sorted((i or 0, *fill(phrase_places(t))) for i, t, *_ in [*odd_rows, *more])
    assert license_scan.scan(none).count() == 0


def test_templates_are_found_with_gaps_and_left_alone_in_prose(spark, prose):
    label, mit = license_scan.TEMPLATES[0]
    broken = mit.replace("restriction,", "any restriction whatever,").replace("modify,", "adapt,")
    texts = [prose(1, 80) + "\n" + mit + "\n" + prose(2, 80), prose(3, 30) + " " + broken, prose(4, 300), "Released under the MIT License.", "the MIT"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = license_scan.scan(df).orderBy("doc_id").collect()
    assert [r.labels for r in found] == ["mit", "mit", "", "mit", ""]
    assert found[0].score == 1.0 and 0.6 < found[1].score < 1.0 and found[2].score == 0.0
    span = max(found[0].spans, key=lambda s: s.coverage)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[0].lower())
    assert words[span.first : span.first + 3] == ["permission", "is", "hereby"] and words[span.last] == "software"


# --- decontamination ---


def edited(rng, words, n, pool):
    words = [*words]
    for _ in range(n):
        k = rng.randrange(len(words))
        what = rng.random()
        if what < 0.34:
            words[k] = rng.choice(pool)
        elif what < 0.67:
            words.insert(k, rng.choice(pool))
        else:
            del words[k]
    return words


def edits(a, b):
    line = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, line[j] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def plain_words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def items_of(prose, n=60):
    return [(k, prose(1000 + k, 8 + k % 40)) for k in range(n)]


def test_planted_passages_are_found(spark, prose, words):
    rng = random.Random(11)
    pool = re.findall(r"\w+", " ".join(words))
    items, docs, planted = items_of(prose), [], set()
    for share in (0.0, 0.1, 0.2):
        for k, text in items:
            item = plain_words(text)
            passage = edited(rng, item, int(share * len(item) + 1e-9), pool)
            docs.append((len(docs), prose(k, 150) + "\n" + ", ".join(x.title() if x.isascii() else x for x in passage) + " " + prose(k + 500, 50)))
            planted.add((docs[-1][0], k))
    clean = [(10_000 + k, prose(5000 + k, 200)) for k in range(60)]
    df = spark.createDataFrame(docs + clean, "doc_id long, text string")
    found = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    exact = {p for p in planted if p[0] < 120}
    assert exact <= pairs and len(pairs & planted) / len(planted) >= 0.93
    assert not {i for i, _ in pairs if i >= 10_000}
    texts = dict(docs)
    for r in found:
        item = plain_words(dict(items)[r.item_id])
        own = plain_words(texts[r.doc_id])[r.start_word : r.start_word + r.n_words]
        assert edits(item, own) == r.edits <= len(item) * 0.2 + 1e-9


def test_odd_tables(spark, odd, none, prose):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, prose(6, 60)), (4, prose(6, 60)), (None, prose(8, 60))], "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = sorted((r.doc_id or 0, r.item_id or 0, r.edits) for r in decontamination.contaminated(odd, items).collect())
    assert [*dict.fromkeys(found)] == [(6, 4, 0), (7, 4, 0), (8, 0, 0)]
    assert decontamination.contaminated(none, items).count() == 0 and decontamination.contaminated(odd, items.limit(0)).count() == 0


def test_blocks_give_what_one_gives(spark, prose, monkeypatch):
    docs = spark.createDataFrame([(k, prose(k, 60) + " " + prose(1000 + k, 8 + k % 40)) for k in range(30)], "doc_id long, text string")
    items = spark.createDataFrame(items_of(prose, 30), "item_id long, text string")
    key = lambda df: sorted((r.doc_id, r.item_id, r.edits) for r in df.collect() if r.edits == 0)
    whole = key(decontamination.contaminated(docs, items))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)
    assert key(decontamination.contaminated(docs, items)) == whole and len(whole) == 30
