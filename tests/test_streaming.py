import glob
import json
import os

from basalt.operators import registry
from basalt.streaming.metric_sink import pushed
from basalt.streaming.registry import apply_stream

SCHEMA = "app string, delta int, seq int, action string, id string, status string"
CHANGES = [
    ("A", 1, 0, "ADDED", "x", "DOWN"), ("A", 1, 1, "ADDED", "y", "UP"), ("B", 1, 2, "MODIFIED", "z", "UP"),
    ("A", 2, 3, "DELETED", "y", None), ("B", 2, 4, "ADDED", "z", "UP"), ("A", 3, 5, "MODIFIED", "w", "UP"), ("B", 3, 6, "DELETED", "z", None),
]


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for delta in (1, 2, 3):
        with open(source / f"{delta}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("app", "delta", "seq", "action", "id", "status"), c, strict=True))) + "\n" for c in CHANGES if c[1] == delta)
        os.utime(source / f"{delta}.json", (delta, delta))
    seen = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    run = apply_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, k: seen.append(df.collect())).trigger(availableNow=True).start()
    run.awaitTermination()
    last = {}
    for rows in seen:
        for app in {r.app for r in rows}:
            last[app] = [(r.id, r.status) for r in sorted((r for r in rows if r.app == app), key=lambda r: r.place) if r.id]
    batch = registry.apply_deltas(spark.createDataFrame(CHANGES, SCHEMA)).orderBy("place").collect()
    assert last == {"A": [(r.id, r.status) for r in batch if r.app == "A"], "B": []}
    assert last["A"] == [("w", "UP"), ("x", "DOWN")]


def test_points_are_posted_in_batches(spark, tmp_path):
    spark.range(10).coalesce(1).write.json(str(tmp_path / "in"))
    out = str(tmp_path / "posts")
    os.makedirs(out)

    def post(rows):
        if any(r["id"] == 4 for r in rows):
            raise OSError("refused")
        with open(f"{out}/{rows[0]['id']}", "w") as f:
            f.write(str(len(rows)))

    points = spark.readStream.schema("id long").json(str(tmp_path / "in"))
    pushed(points, post, ["id"], size=3, period=None).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert {os.path.basename(p): open(p).read() for p in glob.glob(f"{out}/*")} == {"0": "3", "6": "3", "9": "1"}
