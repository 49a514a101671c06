"""Registry payloads and polling, unions of JSON objects, vectors from files, rules with predicates, lists, names and charsets."""

import json

import pytest
from pyspark.sql import functions as F

from basalt.functions import constraints as C
from basalt.functions import text as T
from basalt.operators import chat, config, graph, registry, vectors
from basalt.sources import json_media


def test_metadata_keeps_scalars_only(spark):
    metadata = {"s": "x", "n": 1.5, "b": False, "null": None, "list": [1, 2], "object": {"q": 1}}
    text = json.dumps({"applications": {"application": [{"name": "A", "instance": [{"hostName": "h", "metadata": metadata}, {"hostName": "i"}]}]}})
    found = {r.host: r.metadata for r in registry.instances(spark.createDataFrame([(text,)], "payload string")).collect()}
    assert found == {"h": {"s": "x", "n": "1.5", "b": "false", "status": "UNKNOWN"}, "i": {"status": "UNKNOWN"}}


def test_refused_changes_lead_to_a_snapshot(spark):
    answers = iter([spark.range(1), None, spark.range(2)])
    poller = registry.Poller(lambda: spark.range(5), lambda: next(answers))
    assert [poller.step()[0] for _ in range(5)] == ["snapshot", "delta", "refused", "snapshot", "delta"]
    always = registry.Poller(lambda: spark.range(5), lambda: next(answers), changes=False)
    assert [always.step()[0] for _ in range(3)] == ["snapshot"] * 3


def test_repeated_deltas_of_ranges_and_servers(spark):
    rows = [(k % 2, k, f"s{k // 9 % 3}" if k % 11 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "server int, delta int, stamp string").repartition(7)
    want = [rows[k][1] for k in range(300) if rows[k][2] != (rows[k - 1][2] if k else None)]
    assert sorted(r.delta for r in registry.deduplicated(df).collect()) == want
    by = [k for k in range(300) if rows[k][2] != (rows[k - 2][2] if k > 1 else None)]
    assert sorted(r.delta for r in registry.deduplicated(df, by=["server"]).collect()) == by


def first(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_discriminators(spark):
    t = F.lit(True)
    members = {"a": t, "b": F.lit(False)}
    assert first(spark, C.one_of(members, F.lit("b")), C.one_of(members, F.lit("odd"), strict=False), C.one_of(members, F.lit(None).cast("string"), strict=False)) == ("b", None, None)
    for wrong in (F.lit("odd"), F.lit(None).cast("string")):
        with pytest.raises(Exception, match="discriminator"):
            spark.range(1).select(C.one_of(members, wrong)).collect()


def test_members_by_their_properties(spark):
    v = F.parse_json(F.lit('{"n": 1, "s": "x", "none": null, "list": [1], "o": {}}'))
    assert first(spark, C.matches_member(v, ["n", "none"]), C.matches_member(v, ["n", "gone"]), C.matches_member(v, [], ["gone", "s"]), C.matches_member(v, [], ["gone"]), C.matches_member(v, [])) == (True, False, True, False, False)
    kinds = {"n": "number", "s": "string", "list": "array", "o": "object"}
    assert all(first(spark, *(C.check_property(v, n, k) for n, k in kinds.items())))
    assert not any(first(spark, C.check_property(v, "n", "string"), C.check_property(v, "s", "number"), C.check_property(v, "o", "array"), C.check_property(v, "none"), C.check_property(v, "list", "array", c=C.Constraint(min_items=2))))
    assert all(first(spark, C.check_property(v, "none", "string", nullable=True), C.check_property(v, "gone", "string"), C.check_property(v, "n")))


def test_json_lists_maps_and_objects(spark):
    v = F.parse_json(F.lit('{"l": [1, "a"], "m": {"x": 2}, "s": "t"}'))
    found = first(spark, F.size(T.json_value(v, "$.l", "list")), T.json_value(v, "$.m", "map")["x"].cast("int"), F.to_json(T.json_value(v, "$.m", "object")), T.json_value(v, "$.s", "list").isNull(), T.json_value(v, "$.s", "object").isNull(), T.json_value(v, "$.gone", "map").isNull())
    assert found == (2, 2, '{"x":2}', True, True, True)


def test_vectors_from_a_file(spark, tmp_path):
    (tmp_path / "store.json").write_text(json.dumps([{"id": "a", "embedding": [1, 0.5], "text": "t"}, {"id": "b", "embedding": [0, 1]}]))
    assert [(r.id, r.embedding, r.text) for r in vectors.from_json(spark, str(tmp_path / "store.json")).orderBy("id").collect()] == [("a", [1.0, 0.5], "t"), ("b", [0.0, 1.0], None)]
    assert vectors.from_json(spark).count() == 0


def test_rules_with_predicates(spark):
    df = spark.createDataFrame([("long enough",), ("hey",), (None,)], "text string")
    rules = [chat.Rule(predicate=lambda c: F.length(c) > 5, responder=F.upper), chat.Rule("h.*", "hello")]
    assert [(r.rule, r.answer) for r in chat.answered(df, rules).collect()] == [(0, "LONG ENOUGH"), (1, "hello"), (None, None)]


def test_lists_names_and_reloads(spark):
    df = spark.createDataFrame([([1, 2], [3]), (None, [4]), (None, None)], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(config.united(F.col("a"), F.col("b"))).collect()] == [[1, 2, 3], [4], []]
    assert graph.mapped(spark.createDataFrame([("x", "y", 1)], "title string, tagline string, odd int"), {"title": "title", "tagline": "description"}).collect() == [("x", "y")]
    held = spark.range(3)
    assert config.reloaded(("1", "ca"), ("1", "ca"), lambda: spark.range(9), held) == (("1", "ca"), held)
    tokens, fresh = config.reloaded(("1", "ca"), ("2", "ca"), lambda: spark.range(9), held)
    assert tokens == ("2", "ca") and fresh.count() == 9
    with pytest.warns(UserWarning, match="stays"):
        assert config.reloaded(("1", "ca"), ("2", "ca"), lambda: spark.read.parquet("/nowhere"), held) == (("1", "ca"), held)


def test_json_in_other_charsets_and_with_complex_keys(spark, tmp_path):
    df = spark.createDataFrame([("é",), ("x",)], "title string")
    json_media.write_json(df, str(tmp_path / "out"), "ISO-8859-1")
    assert b"\xe9" in b"".join(f.read_bytes() for f in (tmp_path / "out").glob("*.json"))
    assert sorted(r.title for r in json_media.read_json(spark, str(tmp_path / "out"), "title string", "ISO-8859-1").collect()) == ["x", "é"]
    entries = F.create_map(F.struct(F.lit(1).alias("a")), F.lit("x"))
    assert first(spark, json_media.render_entries(entries)) == ('[[{"a":1},"x"]]',)
