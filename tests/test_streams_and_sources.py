import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import folds
from linkloom.sources import files
from linkloom.streaming import folds as streams


def drain(stream, path, mode="append"):
    out, done = f"{path}/out", f"{path}/checkpoint"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", done).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)


def boxes(n_frames=12):
    rnd = random.Random(3)
    rows = []
    for cam in ("a", "b"):
        for f in range(n_frames):
            for k in range(3):
                if rnd.random() < 0.8:
                    x = 40.0 * k + f + rnd.random()
                    rows.append((cam, f, len(rows), x, 0.0, x + 12, 9.0))
    return rows


def test_tracker_stream_equals_batch(spark, tmp_path):
    schema = "cam string, frame int, id int, x1 double, y1 double, x2 double, y2 double"
    rows = boxes()
    for k, lo in enumerate(range(0, 12, 4)):
        spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 4], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    got = {(r["cam"], r["id"]): r["track"] for r in drain(streams.track_stream(stream, ["cam"]), str(tmp_path)).collect()}
    batch = folds.track_boxes(spark.createDataFrame(rows, schema), ["cam"])
    assert got == {(r["cam"], r["id"]): r["track"] for r in batch.collect()} and 0 < len(got) <= len(rows)


def test_stationary_frames(spark, tmp_path):
    rows = [("v", k, x) for k, x in enumerate([0.0, 0.1, 0.2, 0.9, 1.0, 1.9, 1.85])]
    spark.createDataFrame(rows, "video string, frame int, diff double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video string, frame int, diff double").parquet(str(tmp_path / "in"))
    assert sorted(r["frame"] for r in drain(streams.drop_stationary(stream, "video", "frame", "diff", 0.5), str(tmp_path)).collect()) == [0, 3, 5]


def test_first_deliveries(spark, tmp_path):
    df = spark.sql("select * from values ('a', timestamp'2025-01-01 00:00:00'), ('a', timestamp'2025-01-02 00:00:00'), ('b', timestamp'2025-01-01 00:00:00') t(message_id, received_at)")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert sorted(r["message_id"] for r in drain(streams.first_deliveries(stream, "message_id", "received_at"), str(tmp_path)).collect()) == ["a", "b"]


def test_windows_equal_batch(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    got = {(str(r["start"])[:10], r["event_type"]): r["n"] for r in streams.windowed_counts(events, "ts", "event_type", "value").collect()}
    want = {(r["d"], r["event_type"]): r["n"] for r in events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_json_lines_and_log_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"a": 1, "b": "x"}), "", "{broken", json.dumps({"b": "y"}), "[1]", json.dumps({"a": 2})]))
    good, bad = files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int, b string", ["a"])
    assert {tuple(r) for r in good.collect()} == {(1, "x"), (2, None)}
    assert sorted(r["reason"] for r in bad.collect()) == ["lacks a", "not a JSON object", "not a JSON object"]
    (tmp_path / "log.txt").write_text("[v1] 12 kf, 30 obs\nnoise\n[v2] 7 kf\n")
    rows = files.read_log_lines(spark, str(tmp_path / "log.txt"), r"^\[(\w+)\] (\d+) kf(?:, (\d+) obs)?", {"video": "string", "kf": "int", "obs": "int"})
    assert {tuple(r) for r in rows.collect()} == {("v1", 12, 30), ("v2", 7, None)}


def test_sinks_and_pins(spark, tmp_path):
    good, none = spark.range(3), spark.range(0)
    path = str(tmp_path / "out")
    assert files.publish_if(good, none, path) and spark.read.parquet(path).count() == 3
    assert not files.publish_if(good, good, path) and not (tmp_path / "out").exists()
    log = str(tmp_path / "log")
    assert files.append_events(good.union(good), log, "id") == 3 and files.append_events(spark.range(5), log, "id") == 2 and spark.read.parquet(log).count() == 5
    (tmp_path / "pin").write_bytes(b"abc")
    assert files.pinned(spark, str(tmp_path / "pin"), hashlib.sha256(b"abc").hexdigest())
    with pytest.raises(ValueError, match="pinned"):
        files.pinned(spark, str(tmp_path / "pin"), "0")


def test_folders_documents_and_older_rows(spark, tmp_path):
    for video, body in (("v1", '{"id": 1}\n{"id": 2}\n'), ("v2", '{"id": 3}\n')):
        (tmp_path / "runs" / video).mkdir(parents=True)
        (tmp_path / "runs" / video / "tracks.jsonl").write_text(body)
    got = files.read_by_folder(spark, str(tmp_path / "runs"), "tracks.jsonl", "id long")
    assert {tuple(r) for r in got.collect()} == {(1, "v1"), (2, "v1"), (3, "v2")}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"name": "x",\n "frames": [{"id": 1}, {"id": 2}]}')
    assert [r["id"] for r in files.read_document(spark, str(tmp_path / "d"), "struct<id:long>", "frames").collect()] == [1, 2]
    (tmp_path / "d" / "b.json").write_text("[1]")
    with pytest.raises(ValueError, match="frames"):
        files.read_document(spark, str(tmp_path / "d"), "struct<id:long>", "frames")
    old = spark.createDataFrame([("req", None), ("Result", "2")], "type string, version string")
    new = files.upcast(old, {"version": "1", "producer": "SYSTEM"}, {"type": {"req": "Request"}})
    assert {tuple(r) for r in new.collect()} == {("Request", "1", "SYSTEM"), ("Result", "2", "SYSTEM")}


def test_settings_and_walls(spark):
    allowed = {"k": (int, 1, 10), "share": (float, 0, 1), "on": (bool, None, None)}
    assert files.check_settings({"k": 3}, allowed, {"share": 0.5, "on": True}) == {"k": 3, "share": 0.5, "on": True}
    with pytest.raises(ValueError, match="k: 0 is outside.*|.*x: unknown"):
        files.check_settings({"k": 0, "x": 1, "share": True}, allowed, {})
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    files.refuse_inputs(rows, "id", rows.filter("id = 'c'"), paths=["/data/x"], barred=["truth"])
    for kw in ({"forbidden": rows.filter("id = 'a'")}, {"forbidden": rows.limit(0), "paths": ["/data/truth/x"], "barred": ["truth"]}):
        with pytest.raises(ValueError, match="forbidden"):
            files.refuse_inputs(rows, "id", **kw)


def test_vectors_are_judged(spark):
    rows = [(1, [0.6, 0.8]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [3.0, 4.0]), (7, [None, 1.0])]
    got = {r["k"]: r["rules"] for r in files.vector_violations(spark.createDataFrame(rows, "k int, v array<float>"), "k", "v", 2).collect()}
    assert got == {2: ["NULL"], 3: ["SHAPE"], 4: ["NOT_FINITE"], 5: ["ZERO"], 6: ["NOT_UNIT"], 7: ["NOT_FINITE"]}


def test_cache_computes_what_it_lacks(spark, tmp_path):
    asked = []

    def compute(keys):
        asked.append(sorted(r["k"] for r in keys.collect()))
        return keys.withColumn("v", F.upper("k"))

    run = lambda ks: sorted(tuple(r) for r in files.cached(spark.createDataFrame([(k,) for k in ks], "k string"), str(tmp_path / "c"), ["k"], compute, "v").collect())
    assert run(["a", "b", "a"]) == [("a", "A"), ("a", "A"), ("b", "B")] and run(["b", "c"]) == [("b", "B"), ("c", "C")]
    assert asked == [["a", "b"], ["c"]]


def test_sorted_json_and_cards(spark, tmp_path):
    df = spark.createDataFrame([("x", ((2, None), [(1, "z")]), ["lamp", "box"])], "title string, b struct<q struct<z int, a int>, l array<struct<y int, c string>>>, items array<string>")
    files.write_json(df, str(tmp_path / "j"))
    assert [t for p in (tmp_path / "j").glob("*.json") if (t := p.read_text())] == ['{"b":{"l":[{"c":"z","y":1}],"q":{"a":null,"z":2}},"items":["lamp","box"],"title":"x"}\n']
    card = files.cards(df.withColumn("n", F.lit(None).cast("int")).withColumn("m", F.lit(3)), "title", "title", {"Number": "n", "Size": "m"}, "items").head()["card"]
    assert card == "## x\n- **Size**: 3\n  - lamp\n  - box"
