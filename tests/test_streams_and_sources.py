import json

import pytest
from pyspark.sql import functions as F

from pagewarden import sources, streaming
from pagewarden.operators import captures


def capture(i, url="https://e.com/a?b=c", label="Mail jane@x.io"):
    return {
        "id": i, "receivedAt": 1.5, "task": "t", "sessionId": "s", "stepIndex": i, "url": url, "title": "Hi", "viewport": {"width": 100, "height": 100, "scrollX": 0, "scrollY": 0, "devicePixelRatio": 2},
        "elements": [{"id": "el_0", "role": "textbox", "label": label, "bbox": {"x": 10, "y": 10, "width": 20, "height": 10}, "attributes": {"type": "password"}, "isVisible": True, "isInteractive": True}],
        "redactions": [], "perception": {"modelId": "m", "latencyMs": 3}, "hasScreenshot": False, "error": "boom" if i % 2 else None,
    }


def step(df):
    """A logged capture in the shape of a sent one."""
    page = F.struct("url", "title", F.lit("2026-01-01T00:00:00Z").alias("capturedAt"))
    shot = F.lit(None).cast("struct<mimeType:string,dataBase64:string,width:int,height:int>")
    return df.withColumn("page", page).withColumn("screenshot", shot).drop("url", "title")


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    for i in range(6):
        (tmp_path / "log" / f"{i:04d}.json").write_text(json.dumps(capture(i)))
    (tmp_path / "log" / "0000.png").write_bytes(b"\x89PNG")
    return str(tmp_path / "log")


def test_batch_and_stream_agree(spark, log, tmp_path):
    batch = captures.sanitise(step(sources.read_captures(spark, log)))
    q = streaming.sanitise_stream(step(sources.stream_captures(spark, log, 2)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    rows = lambda df: sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect())
    assert rows(got) == rows(batch) and got.count() == 6
    r = batch.orderBy("id").first()
    assert r["page"]["url"] == "https://e.com/a?[REDACTED]" and r["elements"][0]["label"] == "Mail [REDACTED]" and r["elements"][0]["redacted"]
    assert r["redactions"][0]["category"] == "credential" and tuple(r["redactions"][0]["bbox"]) == (10, 10, 20, 10)


def test_record_keeps_errors(spark, log, tmp_path):
    streaming.record_stream(sources.stream_captures(spark, log), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r["outcome"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("outcome").agg(F.count("*").alias("n")).collect()} == {"ok": 3, "error": 3}


def test_ring(spark, log, tmp_path):
    streaming.keep_ring(sources.stream_captures(spark, log, 2).select("id", "task"), str(tmp_path / "ring"), str(tmp_path / "cp"), limit=3).awaitTermination(120)
    assert [r["id"] for r in streaming.read_ring(spark, str(tmp_path / "ring")).collect()] == [5, 4, 3]
    assert sorted(int(p.name) for p in (tmp_path / "ring").iterdir()) == [1, 2]
    assert [r["id"] for r in streaming.newest(sources.read_captures(spark, log), limit=2).collect()] == [5, 4]


def test_ring_clears_and_survives_a_batch_that_is_run_again(spark, tmp_path):
    import shutil

    src, ring, cp = (str(tmp_path / x) for x in ("src", "ring", "cp"))
    shape = "id long, clear boolean"

    def arrive(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(src)
        streaming.keep_ring(spark.readStream.schema(shape).parquet(src), ring, cp, limit=3).awaitTermination(120)
        return [r["id"] for r in streaming.read_ring(spark, ring).collect()]

    assert arrive([(i, False) for i in range(5)]) == [4, 3, 2]
    assert arrive([(5, False)]) == [5, 4, 3]
    assert arrive([(6, False), (7, True), (8, None)]) == [8]
    assert arrive([(9, False), (10, False)]) == [10, 9, 8]
    # The last batch was written, but not committed: it runs again from the folder before.
    last = max(int(p.name) for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    assert arrive([(11, False)]) == [11, 10, 9]
    assert len(list((tmp_path / "ring").iterdir())) == 2
    shutil.rmtree(ring)


STEPS = "session string, seq int, ts timestamp, action string, target string, text string, canonical string, filled boolean, veto string, ok boolean"


def run_states(spark, tmp_path, rows, batches=1):
    """Rows arrive in ``batches`` files; the log of the state machine."""
    import datetime

    at = datetime.datetime(2026, 1, 1)
    full = [(s, i, at + datetime.timedelta(seconds=i), a, t, x, f"{a}:{t}:{x}", None, v, ok) for i, (s, a, t, x, v, ok) in enumerate(rows)]
    src = str(tmp_path / "steps")
    size = -(-len(full) // batches)
    for k in range(batches):
        spark.createDataFrame(full[k * size : (k + 1) * size], STEPS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(src)
    q = streaming.task_states(stream).writeStream.format("memory").queryName(f"log_{tmp_path.name}").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return [(r["session"], r["step"], r["verdict"], r["status"]) for r in spark.sql(f"SELECT * FROM `log_{tmp_path.name}` ORDER BY session, step, status DESC").collect()]


def test_repeats_end_the_task_at_the_third(spark, tmp_path):
    got = run_states(spark, tmp_path, [("a", "click", "el_1", None, None, None)] * 4 + [("b", "click", "el_1", None, None, None)] * 2 + [("b", "done", None, None, None, None)], batches=1)
    assert [v for s, _, v, _ in got if s == "a"] == ["run", "skip_repeat", "skip_repeat", "stopped"]
    assert [(v, st) for s, _, v, st in got if s == "b"] == [("run", "running"), ("skip_repeat", "running"), ("run", "done")]


def test_states_survive_batches(spark, tmp_path):
    rows = [("a", "type", "el_1", " ", None, None), ("a", "type", "el_1", " ", None, None), ("a", "type", "el_1", " ", None, None), ("a", "click", "el_2", None, None, None), ("a", "click", "el_3", None, "needs_user", None), ("a", "wait", None, None, None, None)]
    got = run_states(spark, tmp_path, rows, batches=3)
    assert sorted(v for _, _, v, _ in got) == sorted(["skip_field", "skip_field", "skip_repeat", "run", "vetoed", "ignored"])


def test_interval_joins(spark):
    frames = spark.createDataFrame([("n1", 1, "2026-01-01 00:00:00"), ("n2", 1, "2026-01-01 00:00:00"), ("n3", 1, "2026-01-01 00:00:00")], "nonce string, tab int, ts string").withColumn("ts", F.to_timestamp("ts"))
    hellos = spark.createDataFrame([("n1", 1, "2026-01-01 00:00:00.300"), ("n2", 1, "2026-01-01 00:00:00.500"), ("n3", 2, "2026-01-01 00:00:00.100")], "nonce string, tab int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["nonce"]: r["read"] for r in streaming.hello_frames(frames, hellos).collect()} == {"n1": True, "n2": False, "n3": False}
    asked = spark.createDataFrame([("s1", "2026-01-01 00:00:00"), ("s2", "2026-01-01 00:00:00")], "session string, ts string").withColumn("ts", F.to_timestamp("ts"))
    said = spark.createDataFrame([("s1", "2026-01-01 00:01:59", True, "fill"), ("s2", "2026-01-01 00:02:01", True, "fill")], "session string, ts string, allow boolean, kind string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["session"]: r["allowed"] for r in streaming.approvals(asked, said).collect()} == {"s1": True, "s2": False}
    assert {r["outcome"] for r in streaming.given_answers(asked, said).collect()} == {"fill"}
    assert {r["session"]: r["state"]["n"] for r in streaming.latest_states(said.withColumn("n", F.lit(3))).collect()} == {"s1": 3, "s2": 3}


def test_labels_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p1", 0, 1, 10.0, 20.0, 30.0, 40.0), ("p1", 1, 0, 0.0, 0.0, 5.0, 5.0), ("p2", 0, 2, 1.0, 1.0, 2.0, 2.0)], "image_id string, idx int, cls int, x double, y double, width double, height double")
    sources.write_labels(df.withColumn("vw", F.lit(100.0)).withColumn("vh", F.lit(200.0)), str(tmp_path / "labels"))
    (tmp_path / "one.txt").write_text("0 0.5 0.5 0.1 0.1\n\n2 0.25 0.2 0.3 0.2\n")
    got = sources.read_labels(spark, str(tmp_path / "one.txt")).orderBy("line_no").collect()
    assert [(r["image_id"], r["id"], r["cls"], r["w"]) for r in got] == [("one", "gt_0", 0, 0.1), ("one", "gt_1", 2, 0.3)]
    assert (tmp_path / "labels" / "p1.txt").read_text() == "1 0.250000 0.200000 0.300000 0.200000\n0 0.025000 0.012500 0.050000 0.025000\n"
    back = sources.read_labels(spark, str(tmp_path / "labels"))
    assert {(r["image_id"], r["line_no"], r["cls"], r["cx"], r["h"]) for r in back.collect()} == {("p1", 0, 1, 0.25, 0.2), ("p1", 1, 0, 0.025, 0.025), ("p2", 0, 2, 0.02, 0.01)}
    q = sources.stream_labels(spark, str(tmp_path / "labels"), 1).writeStream.format("memory").queryName("labels_back").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("SELECT * FROM labels_back").collect())) == sorted(map(tuple, back.collect()))


def test_named_files_of_any_names(spark, tmp_path):
    from pagewarden.sources.named import read_named, write_named

    names = ["plain", "a/b", "50% off+more", "x y", "é", "..", "_hidden", ".dot", "q?#&=", "part-00000", "UPPER.txt"]
    df = spark.createDataFrame([(n, f"content of {n}\n\nend") for n in names] + [(None, "x"), ("none", None), ("", "x")], "name string, content string").repartition(3)
    for _ in range(2):
        write_named(df, str(tmp_path / "n"), ".txt")
        got = {r["name"]: r["content"] for r in read_named(spark, str(tmp_path / "n"), ".txt").collect()}
        assert got == {n: f"content of {n}\n\nend" for n in names}
    write_named(df.where("name = 'plain'"), f"file://{tmp_path}/n", ".txt")
    assert sorted(p.name for p in (tmp_path / "n").iterdir() if not p.name.startswith(".")) == ["_SUCCESS", "plain.txt"]


def test_captures_written_and_read_back(spark, log, tmp_path):
    df = sources.read_captures(spark, log)
    sources.write_captures(df, str(tmp_path / "again"))
    assert sorted(p.name for p in (tmp_path / "again").glob("*.json")) == [f"{i}.json" for i in range(6)]
    rows = lambda d: sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in d.collect())
    assert rows(sources.read_captures(spark, str(tmp_path / "again"))) == rows(df)


def test_files(spark, log, tmp_path):
    shots = sources.read_screenshots(spark, log).collect()
    assert [(r["stem"], r["mime"], bytes(r["content"])) for r in shots] == [("0000", "image/png", b"\x89PNG")]
    (tmp_path / "page.json").write_text(json.dumps({"viewport": {"width": 10, "height": 20}, "links": [{"label": "a", "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}}], "frames": [{"x": 5, "y": 6, "width": 7, "height": 8}]}))
    got = sources.read_fixtures(spark, str(tmp_path / "page.json")).collect()
    assert {(r["role"], r["label"], r["x"], r["vw"]) for r in got} == {("link", "a", 1.0, 10.0), ("frame", None, 5.0, 10.0)}
    r = spark.createDataFrame([("aGk=",), ("not base64!",), (None,)], "t string").select(sources.decode_base64(F.col("t")).alias("b")).collect()
    assert [x["b"] and bytes(x["b"]) for x in r] == [b"hi", None, None]
    sources.write_results(spark.range(3), str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res/table")).count() == spark.read.json(str(tmp_path / "res/json")).count() == 3
