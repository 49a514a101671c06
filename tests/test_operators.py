"""Small cases with results worked out by hand."""

import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basalt.functions import constraints as C
from basalt.functions import text as T
from basalt.functions import units as U
from basalt.operators import chat, config, graph, keyvalue, metrics, registry, vectors
from basalt.sources import json_media, toml


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


# --- functions ---


def test_replace_first_replaces_one_match(spark):
    assert one(spark, T.replace_first(F.lit("ab ab"), "(a)b", "<$1>"), T.replace_first(F.lit("xyz"), "q", "w"), T.replace_first(F.lit("ab"), "(.*)", "<$1>")) == ("<a> ab", "xyz", "<ab>")


def test_full_match_is_anchored(spark):
    assert one(spark, T.full_match(F.lit("ab"), "a|ab"), T.full_match(F.lit("ab\n"), "ab"), T.full_match(F.lit("cab"), "ab")) == (True, False, False)


def test_token_estimate_and_split(spark):
    assert one(spark, T.token_estimate(F.lit("abc")), T.token_estimate(F.lit("abcdefghi")), T.token_estimate(F.lit(None).cast("string")), T.split_keeping(F.lit("a  b"))) == (1, 2, 1, ["a", " ", " ", "b"])


def test_ttl(spark):
    assert one(spark, *(T.ttl_text(F.lit(s)) for s in (7200, 5400, 61, 0))) == ("2h", "90m", "61s", "0h")


def test_json_scalars(spark):
    v = F.parse_json(F.lit('{"a": null, "b": 1.5, "c": "x", "d": [1], "e": "", "f": "YQ=="}'))
    assert one(spark, T.json_scalar(v, "$.a"), T.json_scalar(v, "$.b"), T.json_scalar(v, "$.c"), T.json_scalar(v, "$.z")) == ("null", "1.5", "x", None)
    assert one(spark, T.json_value(v, "$.e", "instant"), T.json_value(v, "$.c", "int"), T.json_value(v, "$.f", "bytes")) == (None, None, bytearray(b"a"))
    with pytest.raises(Exception, match="no scalar"):
        one(spark, T.json_scalar(v, "$.d"))


def test_common_path(spark):
    of = lambda *p: T.common_path(F.array(*map(F.lit, p)))
    assert one(spark, of("/a/b/c", "/a/b/d"), of("/a/{id}/x", "/a/{id}/y"), of("/a", "/b"), of("/a/b")) == ("/a/b", "/a", "/", "/a/b")


def test_change_token(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, T.change_token(F.lit(3), s("e"), s("h")), T.change_token(s(None), s(" "), s("h")), T.change_token(s(None), s(" e "), s("h"))) == ("3", "h", "e")


def test_units(spark):
    assert one(spark, U.converted(F.lit(2.0), F.lit("Minutes")), U.converted(F.lit(8.0), F.lit("bits")), U.converted(F.lit(5.0), F.lit("cats")), U.base_unit(F.lit("gigabits"))) == (120.0, 1.0, 5.0, "bytes")
    assert one(spark, U.metric_name(F.lit("a"), F.lit("Distribution Summary"), F.lit("max"), F.lit("bytes"))) == ("a_max_distribution_summary_bytes",)


# --- constraints ---


def test_bounds_and_multiples_are_exact(spark):
    c = C.Constraint(multiple_of=Decimal("0.1"), minimum=Decimal("0.7"), exclusive_minimum=True)
    assert one(spark, C.check(F.lit(0.8), c), C.check(F.lit(0.75), c), C.check(F.lit(0.7), c), C.check(F.lit(None).cast("double"), c)) == (True, False, False, True)


def test_integral_bounds():
    c = C.integral(C.Constraint(minimum=Decimal("2.5"), maximum=Decimal(9), exclusive_maximum=True))
    assert (c.minimum, c.maximum, c.exclusive_maximum) == (3, 8, False)
    assert C.integral(C.Constraint(minimum=Decimal(2), exclusive_minimum=True)).minimum == 3
    assert C.integral(C.Constraint(maximum=Decimal(1 << 70))).maximum is None


def test_merging_constraints():
    a, b = C.Constraint(minimum=Decimal(1), min_length=2), C.Constraint(minimum=Decimal(1), exclusive_minimum=True, max_length=5)
    assert C.merged(a, b) == C.Constraint(minimum=Decimal(1), exclusive_minimum=True, min_length=2, max_length=5)
    for x, y in ((C.Constraint(pattern="a"), C.Constraint(pattern="b")), (C.Constraint(min_items=3), C.Constraint(max_items=2)), (C.Constraint(minimum=Decimal(1), exclusive_minimum=True), C.Constraint(maximum=Decimal(1)))):
        with pytest.raises(ValueError):
            C.merged(x, y)


def test_enums_and_cycles():
    assert C.enum_names(["a b", "a-b", "1"]) == {"a b": "A_B", "a-b": "A_B_2", "1": "_1"}
    with pytest.raises(ValueError):
        C.enum_names(["a", "a"])
    with pytest.raises(ValueError, match="a -> b -> a"):
        C.acyclic({"a": ["b"], "b": ["a"]})


def test_unions(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, C.one_of({"a": t, "b": f}), C.one_of({"a": t, "b": t}), C.one_of({"a": f, "b": f}), C.one_of({"a": t, "b": t}, F.lit("bee"), {"bee": "b"})) == ("a", None, None, "b")
    assert one(spark, C.any_of_best({"a": F.lit(2), "b": F.lit(1)}), C.any_of_best({"a": F.lit(2), "b": F.lit(2)}), C.any_of_best({"a": F.lit(0)})) == ("a", None, None)


# --- retrieval ---


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in vectors.top_k(df, [2.0, 0.0], 2).collect()] == [(1, 1.0), (2, 1.0)]
    assert [r.vec_id for r in vectors.top_k(df, [2.0, 0.0], 9, min_score=0.0).collect()] == [1, 2, 3]
    queries = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [0.0, 0.0])], "query_id string, embedding array<double>")
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in vectors.top_k_each(df, queries, 2).collect())
    assert found == [("x", 1, 1), ("x", 2, 2), ("y", 1, 3), ("y", 2, 1)]
    assert vectors.top_k_each(df, queries.limit(0), 2).count() == 0
    hits = spark.createDataFrame([("q", 1, 0.1), ("q", 2, 0.9)], "q string, id long, s double")
    assert [r.id for r in vectors.reranked(hits, F.col("s"), 1, "q", "id").collect()] == [2]


# --- chat ---

MESSAGES = [(1, 0, "system", "be "), (1, 1, "user", "hi there"), (1, 2, "tool", "no"), (1, 3, "assistant", "yo"), (2, 0, "user", None)]


def messages(spark):
    return spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")


def test_chat(spark):
    m = messages(spark)
    assert {(r.conv_id, r.text) for r in chat.concatenated(m).collect()} == {(1, "be hi thereyo"), (2, "")}
    assert {tuple(r) for r in chat.usage(m).collect()} == {(1, 2, 1, 3), (2, 1, 1, 2)}
    assert {(r.conv_id, r.turn) for r in chat.memory(m, 2).collect()} == {(1, 2), (1, 3), (2, 0)}
    assert {(r.turn, r.n_tokens, r.text) for r in chat.assembled(chat.stream(m.where("conv_id = 1"))).collect()} == {(0, 2, "be "), (1, 3, "hi there"), (2, 1, "no"), (3, 1, "yo")}
    counts = {r.bucket: r.n for r in chat.histogram(m, [], F.length("text"), [2, 4]).collect()}
    assert counts == {2.0: 2, 4.0: 3, None: 4}


def test_rules(spark):
    rules = (chat.Rule("h.*", template=None, response="hey"), chat.Rule("(.)o", template="$1!"), chat.Rule())
    assert [(r.rule, r.answer) for r in chat.answered(messages(spark), rules).orderBy("conv_id", "turn").collect()] == [(2, chat.NO_ANSWER), (0, "hey"), (1, "n!"), (1, "y!"), (None, None)]


def test_token_streams_end(spark):
    df = spark.createDataFrame([(1, 0, "token", "a"), (1, 1, "end", None), (1, 2, "token", "b")], "s long, seq long, kind string, token string")
    assert [r.token for r in chat.until_end(df, ["s"]).collect()] == ["a"]
    broken = spark.createDataFrame([(1, 0, "token", "a"), (1, 1, "error", "gone")], "s long, seq long, kind string, token string")
    with pytest.raises(Exception, match="gone"):
        chat.until_end(broken, ["s"]).collect()


# --- metrics ---


def test_a_counter_and_a_timer_give_four_points(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, v double")
    points = metrics.counters(df, ["k"]).unionByName(metrics.timers(df, ["k"], "v"))
    assert {(r.suffix, r.value) for r in points.collect()} == {("count", 2.0), ("seconds_count", 2.0), ("mean_seconds", 2.0), ("max_seconds", 3.0)}
    empty = spark.createDataFrame([("a", None)], "k string, v double")
    assert {r.suffix for r in metrics.summaries(empty, ["k"], "v", "bytes").collect()} == {"bytes_count"}
    nan = spark.createDataFrame([("a", float("nan"), 1)], "k string, v double, t int")
    assert metrics.gauges(nan, ["k"], "v", ["t"]).count() == 0


def test_scopes(spark):
    df = spark.createDataFrame([("vendor",), ("base",), (None,)], "scope string")
    assert metrics.scoped(df, [" Vendor "]).count() == 1 and metrics.scoped(df, ["*"]).count() == 3


def test_ten_points_in_batches_of_three(spark):
    assert sorted(r.n_points for r in metrics.posts(metrics.batched(spark.range(10), 3, order=["id"])).collect()) == [1, 3, 3, 3]


# --- registry ---


def payload(*apps):
    return json.dumps({"applications": {"versions__delta": "1", "apps__hashcode": "UP_1_", "application": [{"name": n, "instance": i} for n, i in apps]}})


def instance(name, status="UP", **more):
    return {"instanceId": name, "hostName": "localhost", "status": status, "port": {"$": 80, "@enabled": "true"}, "securePort": {"$": 443, "@enabled": "false"}, "metadata": {"a": "1", "b": None}} | more


def test_instances_and_snapshot(spark):
    text = payload(("EXAMPLE", [instance("x", "DOWN"), instance("x"), instance("y", "odd"), {"instanceId": "z"}]), (None, [instance("w")]))
    found = registry.instances(spark.createDataFrame([(text,)], "payload string"))
    assert found.count() == 3
    rows = {r.id: r for r in registry.snapshot(found).collect()}
    assert (rows["x"].status, rows["x"].port, rows["x"].secure_port, rows["x"].metadata) == ("UP", 80, -1, {"a": "1", "status": "UP"})
    assert rows["y"].status == "UNKNOWN" and (rows["x"].seq, rows["y"].seq) == (1, 2)


def fold(spark, *changes):
    df = spark.createDataFrame([(*c[:2], k, *c[2:]) for k, c in enumerate(changes)], "app string, delta int, seq int, action string, id string, status string")
    return [(r.app, r.id, r.status) for r in registry.apply_deltas(df).orderBy("app", "place").collect()]


def test_deltas_apply_in_phases(spark):
    # a modification of nothing is nothing; additions come after it whatever the order
    assert fold(spark, ("A", 1, "ADDED", "x", "UP"), ("A", 1, "MODIFIED", "y", "UP")) == [("A", "x", "UP")]
    assert fold(spark, ("A", 1, "ADDED", "x", "DOWN"), ("A", 2, "MODIFIED", "y", "UP"), ("A", 2, "ODD", "x", "UP")) == [("A", "y", "UP"), ("A", "x", "DOWN")]
    # deletion first, so the addition of the same delta stays
    assert fold(spark, ("A", 1, "ADDED", "x", "UP"), ("A", 2, "ADDED", "x", "DOWN"), ("A", 2, "DELETED", "x", None)) == [("A", "x", "DOWN")]
    assert fold(spark, ("A", 1, "ADDED", "x", "UP"), ("A", 2, "DELETED", "x", None), ("B", 1, "ADDED", "z", "UP")) == [("B", "z", "UP")]


def test_uris(spark):
    df = spark.createDataFrame([("A", "x", "h", 443, 8080), ("A", "y", "h", -1, -1)], "app string, id string, host string, secure_port int, port int")
    assert [r.uri for r in registry.uris(df, default="https://h").orderBy("id", "n").collect()] == ["http://h:8080", "https://h", "https://h"]


def test_snapshot_replacement(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert registry.replace_snapshot(spark, spark.range(3), path, "UP_3_")
    assert not registry.replace_snapshot(spark, spark.range(9), path, "UP_3_")
    assert registry.current_snapshot(spark, path).count() == 3
    assert registry.replace_snapshot(spark, spark.range(9), path, "UP_9_") and registry.current_snapshot(spark, path).count() == 9


def test_repeated_deltas(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "delta int, stamp string")
    assert [r.delta for r in registry.deduplicated(df).orderBy("delta").collect()] == [1, 3, 4]


# --- graph, keys, configuration ---


def test_collected_lists_repeat_as_the_product(spark):
    films = spark.createDataFrame([("m",), ("lonely",)], "title string")
    directors = spark.createDataFrame([("m", "d1"), ("m", "d2")], "title string, name string")
    actors = spark.createDataFrame([("m", "a1"), ("m", "a2"), ("m", "a3"), ("lonely", "a1")], "title string, name string")
    r = graph.collected_pattern(films, "title", directors, actors, F.col("name"), F.col("name")).collect()
    assert [(x.title, x.list_a, x.list_b) for x in r] == [("m", ["d1"] * 3 + ["d2"] * 3, ["a1"] * 2 + ["a2"] * 2 + ["a3"] * 2)]


def test_pattern_digests_are_those_of_the_lists(spark, monkeypatch):
    """Lists of 10**9 pairs, far more than a row holds; short ones as collected; null texts, equal nodes and nodes without one kind."""
    films = spark.createDataFrame([("m",), ("m",), ("long",), ("lonely",), ("none",)], "title string")
    directors = spark.createDataFrame([("m", "d2"), ("m", "d1"), ("m", None), ("none", None), (None, "x")], "title string, name string")
    actors = spark.createDataFrame([("m", "a1"), ("m", "a3"), ("lonely", "a1"), ("none", "a")], "title string, name string")
    md5 = lambda *x: hashlib.md5(",".join(x).encode()).hexdigest()
    found = lambda: {r.title: (r.n, r.md5_a, r.md5_b) for r in graph.collected_digests(films, "title", directors, actors, F.col("name"), F.col("name"), ["name"], ["name"]).collect()}
    wanted = {"m": (12, md5(*["d1"] * 4, *["d2"] * 4), md5(*["a1"] * 6, *["a3"] * 6)), "none": (1, None, md5("a"))}
    assert found() == wanted
    monkeypatch.setattr(graph, "DIGEST_BYTES", 7)
    assert found() == wanted
    monkeypatch.undo()
    many = lambda n: spark.range(n).select(F.lit("long").alias("title"), F.lit("x").alias("name"))
    r = graph.collected_digests(films, "title", many(25_000), many(40_000), F.col("name"), F.col("name"), ["name"], ["name"]).first()
    whole = hashlib.md5(b"x")
    for _ in range(999):
        whole.update(b",x" * 1_000_000)
    whole.update(b",x" * 999_999)
    assert (r.n, r.md5_a, r.md5_b) == (10**9, whole.hexdigest(), whole.hexdigest())


def test_health(spark):
    df = spark.createDataFrame([("kernel", 1)], "name string, v int")
    assert [r.status for r in graph.single_row(df, "name", "kernel").collect() + graph.single_row(df, "name", "other").collect()] == ["UP", "DOWN"]


def test_keys(spark):
    schema = "path string, version long, data string, deleted boolean, destroyed boolean"
    history = spark.createDataFrame([("a", 1, "x", False, False), ("a", 2, "y", False, False), ("b", 1, "z", True, False)], schema)
    assert [(r.path, r.data) for r in keyvalue.latest(history).collect()] == [("a", "y")]
    assert [r.path for r in keyvalue.at_version(history, 1).collect()] == ["a"]
    fresh = spark.createDataFrame([("a", "n"), ("c", "n")], "path string, data string")
    assert keyvalue.create_if_absent(history, fresh).where("data = 'n'").collect()[0].path == "c"
    changes = spark.createDataFrame([("a", "n", 2), ("b", "n", 0), ("c", "n", 0)], "path string, data string, expected long")
    assert {(r.path, r.version) for r in keyvalue.update(history, changes).where("data = 'n'").collect()} == {("a", 3), ("c", 1)}
    assert keyvalue.delete_all(history, fresh).count() == 1
    gone = keyvalue.flagged(history, history.where("version = 2").select("path", "version"), destroyed=True)
    assert gone.where("destroyed").collect()[0].data is None
    assert keyvalue.put(fresh, spark.createDataFrame([("a", "m")], "path string, data string")).where("path = 'a'").collect()[0].data == "m"


def test_configuration(spark):
    layers = spark.createDataFrame([("m", "t", "1", 0), ("m", "t", "2", 1), ("m", "u", "3", 0), ("m", "list", "a", 0), ("m", "list", "b", 0), ("m", "list", "c", 1)], "name string, key string, value string, level int")
    assert {(r.key, r.value) for r in config.merged(layers).collect()} == {("t", "2"), ("u", "3"), ("list", "c")}
    named = spark.createDataFrame([("store", "x", "provider", "mem"), ("store", "y", "provider", "db")], "category string, name string, key string, value string")
    assert [r.name for r in config.named_components(named, "store", "mem").collect()] == ["x"]
    parts = spark.createDataFrame([("r", "s", "m")], "name string, store string, model string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert tuple(config.resolved(parts, names("s"), names("other")).first()) == ("r", "s", None)
    with pytest.raises(Exception, match="no store"):
        config.resolved(parts, names("t"), names("m")).collect()
    weights = spark.createDataFrame([("a", 1), ("b", 2)], "name string, weight int")
    assert config.default_component(weights).first().name == "b"


# --- sources ---

DOCUMENT = """
title = "x"
n = 1_000
f = 6.25e2
bad = -nan
big = +inf
[at]
day = 2024-05-06
when = 2024-05-06T07:08:09.123456Z
local = 2024-05-06 07:08:09
clock = 07:32:00
"q.r" = [1, "a", {k = true}]
[[row]]
a = 1
[[row]]
a = 2
"""


def test_toml(spark, tmp_path):
    (tmp_path / "d.toml").write_text(DOCUMENT)
    wanted = {
        ("title", "string", "x"), ("n", "integer", "1000"), ("f", "float", "625.0"), ("bad", "float", "nan"), ("big", "float", "inf"), ("at.day", "local_date", "2024-05-06"),
        ("at.when", "offset_datetime", "2024-05-06T07:08:09.123456+00:00"), ("at.local", "local_datetime", "2024-05-06T07:08:09"), ("at.clock", "local_time", "07:32:00"),
        ("at.q~1r.0", "integer", "1"), ("at.q~1r.1", "string", "a"), ("at.q~1r.2.k", "boolean", "true"), ("row.0.a", "integer", "1"), ("row.1.a", "integer", "2"),
    }
    rows = lambda df: {(r.key, r.kind, r.text) for r in df.collect()}
    assert rows(toml.read(spark, str(tmp_path))) == wanted
    spark.dataSource.register(toml.TomlSource)
    assert rows(spark.read.format("toml").load(str(tmp_path))) == wanted
    config_rows = {r.key: r.value for r in toml.as_config(toml.read(spark, str(tmp_path))).collect()}
    assert (config_rows["bad"], config_rows["big"], config_rows["f"]) == ("NaN", "Infinity", "625.0")


@pytest.mark.parametrize("text", ["a = 1\na = 2", "a = 99999999999999999999", "[a]\n[a]", "a = {b = 1}\na.c = 2", "a = 1\rb = 2", "a ="])
def test_wrong_toml(spark, text):
    df = spark.createDataFrame([("p", text)], "path string, content string")
    assert [r.kind for r in toml.parse(df, on_error="row").collect()] == ["error"]
    with pytest.raises(Exception, match="p:"):
        toml.parse(df).collect()


def test_json_media(spark, tmp_path):
    path = str(tmp_path / "b.json")
    with open(path, "w", encoding="utf-16") as f:
        f.write('{"title": "é"}\n')
    assert [r.title for r in json_media.read_json(spark, path, "title string", "UTF-16", many=True).collect()] == ["é"]
    s = F.struct(F.lit("<a>").alias("x"), F.lit(None).cast("int").alias("y"))
    assert one(spark, json_media.render(s), json_media.render(s, nulls=True), json_media.render(s, escape_html=True)) == ('{"x":"<a>"}', '{"x":"<a>","y":null}', '{"x":"\\u003ca\\u003e"}')
