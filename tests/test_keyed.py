"""Ordered folds with time limits: cases by hand, random events, streams against tables, and state that goes."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewarden import streaming
from pagewarden.operators import pages
from pagewarden.operators import sessions as S

T0 = datetime.datetime(2026, 1, 1)
FAR = T0 + datetime.timedelta(days=2)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def stream_of(spark, folder, rows, shape, batches=3):
    """Rows in the given order, some files one after another."""
    size = max(1, -(-len(rows) // batches))
    for k in range(0, max(len(rows), 1), size):
        spark.createDataFrame(rows[k : k + size], shape).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run_stream(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(f"{name}_{tmp_path.name}").option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return Counter(tuple(r) for r in spark.sql(f"SELECT * FROM `{name}_{tmp_path.name}`").collect()), states


# ST-6

RUNS = "tab string, started_at timestamp, finished_at timestamp"


def greedy(rows):
    out, end = Counter(), {}
    for tab, a, b in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        refused = tab in end and a < end[tab]
        if not refused:
            end[tab] = b
        out[tab, a, b, refused] += 1
    return out


def test_a_refused_run_blocks_nobody(spark):
    df = spark.createDataFrame([("a", at(0), at(60)), ("a", at(30), at(90)), ("a", at(70), at(130)), ("b", at(10), at(20)), ("b", at(20), at(30))], RUNS)
    got = S.overlapping_steps(df.select("*", F.lit(1).alias("other.column"))).orderBy("tab", "started_at").collect()
    assert [r["refused"] for r in got] == [False, True, False, False, False] and got[0]["other.column"] == 1


def test_runs_without_times(spark):
    df = spark.createDataFrame([("a", None, at(60)), ("a", at(0), at(5)), ("a", at(10), None), ("a", at(99), at(100)), (None, at(0), at(9)), (None, at(1), at(2))], RUNS)
    got = Counter((r["tab"], r["started_at"], r["refused"]) for r in S.overlapping_steps(df).collect())
    assert got == Counter({("a", None, False): 1, ("a", at(0), False): 1, ("a", at(10), False): 1, ("a", at(99), True): 1, (None, at(0), False): 1, (None, at(1), True): 1})
    assert S.overlapping_steps(df.where("false")).collect() == []


def test_random_runs_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"t{rng.randrange(6)}", at(s := rng.randrange(4000)), at(s + rng.randrange(1, 300))) for _ in range(300)]
    want = greedy(rows)
    assert Counter(tuple(r) for r in S.overlapping_steps(spark.createDataFrame(rows, RUNS)).collect()) == want
    rows.sort(key=lambda r: r[1])
    stream = stream_of(spark, tmp_path / "runs", [*rows, ("zz", FAR, FAR)], RUNS, 5)
    got, states = run_stream(spark, streaming.runs_one_at_a_time(stream), tmp_path, "runs")
    assert got == want + Counter({("zz", FAR, FAR, False): 1})
    assert max(states) > 1 and states[-1] <= 1  # of the last run alone


# ST-3

EVENTS = "browser string, kind string, id string, nonce string, tab string, frame string, ts timestamp"
SEEN = ["browser", "id", "nonce", "tab", "read", "frame"]


def desk(df, limit=256):
    r = streaming.hello_frames(df.where("kind = 'frame'").drop("kind", "frame"), df.where("kind = 'hello'").drop("kind", "id"), by="browser", limit=limit)
    return r.select(*SEEN)


def read_by(rows, limit=256):
    """What each frame read, by the rules: {(browser, id): frame or None}"""
    out = {}
    for browser in {r[0] for r in rows}:
        parked, waiting = {}, {}
        for _, kind, id_, nonce, tab, frame, ts in sorted((r for r in rows if r[0] == browser), key=lambda r: (r[6], r[1], r[2] or "")):
            for n, (limit_at, i, t) in sorted(waiting.items(), key=lambda x: x[1]):
                if limit_at < ts:
                    out[browser, i] = None
                    del waiting[n]
            if kind == "frame" and nonce in parked:
                t, f = parked.pop(nonce)
                out[browser, id_] = f if t == tab else None
            elif kind == "frame":
                waiting[nonce] = (ts + datetime.timedelta(milliseconds=400), id_, tab)
            elif nonce in waiting:
                _, i, t = waiting.pop(nonce)
                out[browser, i] = frame if t == tab else None
            elif len(parked) < limit:
                parked[nonce] = (tab, frame)
        out |= {(browser, i): None for _, i, _ in waiting.values()}
    return out


def test_hellos_early_late_twice_and_from_elsewhere(spark):
    frame = lambda i, n, s, tab="1": ("b", "frame", i, n, tab, None, at(s))
    hello = lambda f, n, s, tab="1": ("b", "hello", None, n, tab, f, at(s))
    rows = [
        hello("f1", "early", 1.0), frame("early", "early", 1.1), frame("again", "early", 2.0),  # taken once
        frame("intime", "n2", 3.0), hello("f2", "n2", 3.4), frame("late", "n3", 4.0), hello("f3", "n3", 4.401),
        frame("after", "n3", 9.0),  # the late one stayed parked
        frame("elsewhere", "n4", 10.0), hello("f4", "n4", 10.1, "2"), hello("f5", "n5", 11.0, "2"), frame("parked elsewhere", "n5", 11.1), frame("never", "n6", 12.0),
    ]
    got = {r["id"]: r["frame"] if r["read"] else None for r in desk(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {"early": "f1", "again": None, "intime": "f2", "late": None, "after": "f3", "elsewhere": None, "parked elsewhere": None, "never": None}
    assert {("b", i): f for i, f in got.items()} == read_by(rows)


def test_no_more_than_256_are_parked(spark):
    rows = [("b", "hello", None, f"n{i}", "1", f"f{i}", at(i)) for i in range(258)] + [("b", "frame", str(i), f"n{i}", "1", None, at(1000 + i)) for i in (0, 255, 256, 257)]
    rows += [("b", "hello", None, "n300", "1", "f300", at(2000)), ("b", "frame", "300", "n300", "1", None, at(2001)), ("c", "hello", None, "n9", "1", "f9", at(5)), ("c", "frame", "9", "n9", "1", None, at(6))]
    got = {r["id"]: r["read"] for r in desk(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {"0": True, "255": True, "256": False, "257": False, "300": True, "9": True}


def test_hellos_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(250):
        s, browser, tab = rng.uniform(0, 600), f"b{i % 3}", rng.choice("12")
        rows.append((browser, "frame", f"id{i}", f"n{i}", tab, None, at(round(s, 3))))
        if rng.random() < 0.8:
            rows.append((browser, "hello", None, f"n{i}", rng.choice([tab, tab, "3"]), f"f{i}", at(round(s + rng.uniform(-2, 1), 3))))
    want = read_by(rows, 5)
    batch = {(r["browser"], r["id"]): r["frame"] for r in desk(spark.createDataFrame(rows, EVENTS), 5).collect()}
    assert batch == want and len({f is None for f in want.values()}) == 2
    rows.sort(key=lambda r: r[6])
    stream = stream_of(spark, tmp_path / "events", [*rows, ("zz", "hello", None, "n", "1", "f", FAR)], EVENTS, 4)
    got, _ = run_stream(spark, desk(stream, 5), tmp_path, "desk")
    assert {(b, i): f for b, i, _, _, _, f in got} == want


# ST-2, ST-4

STEPS = "session string, seq int, ts timestamp, action string, target string, text string, canonical string, filled boolean, veto string, ok boolean, risk string, asks boolean"
REPLIES = "session string, ts timestamp, kind string"


def command(session, seq, seconds, action="click", target="el_1", risk=None, asks=False, veto=None, ok=True, text=None):
    return (session, seq, at(seconds), action, target, text, f"{action}:{target}:{text}:{seq}", None, veto, ok, risk, asks)


CASES = [
    ("allowed", [command("allowed", 0, 0, risk="Click"), command("allowed", 1, 200)], [(120, "allow")], [("asked", "confirm"), ("run", "running"), ("run", "running")]),
    ("late", [command("late", 0, 0, risk="Click"), command("late", 1, 200)], [(120.001, "allow")], [("asked", "confirm"), ("refused", "stopped"), ("ignored", "stopped")]),
    ("silent", [command("silent", 0, 0, risk="Click")], [], [("asked", "confirm"), ("refused", "stopped")]),
    ("refused", [command("refused", 0, 0, risk="Click")], [(3, "refuse"), (4, "allow")], [("asked", "confirm"), ("refused", "stopped")]),
    ("answered", [command("answered", 0, 0, asks=True), command("answered", 1, 700)], [(599, "fill")], [("asked", "input"), ("answered", "running"), ("run", "running")]),
    ("unanswered", [command("unanswered", 0, 0, asks=True), command("unanswered", 1, 700)], [(601, "fill")], [("asked", "input"), ("unanswered", "stopped"), ("ignored", "stopped")]),
    ("stop", [command("stop", 0, 0), command("stop", 1, 5)], [(2, "stop")], [("run", "running"), ("stopped", "stopped"), ("ignored", "stopped")]),
    ("wrong reply", [command("wrong reply", 0, 0, risk="Pay")], [(1, "fill"), (2, "allow")], [("asked", "confirm"), ("run", "running")]),
    ("done", [command("done", 0, 0, action="done", risk="x")], [(1, "allow")], [("asked", "confirm"), ("run", "done")]),
    ("early", [command("early", 0, 5, risk="Pay"), command("early", 1, 50)], [(1, "allow")], [("asked", "confirm"), ("ignored", "confirm"), ("refused", "stopped")]),
]


def test_approvals_and_answers_within_the_task(spark, tmp_path):
    steps = [c for _, own, _, _ in CASES for c in own]
    replies = [(name, at(s), kind) for name, _, own, _ in CASES for s, kind in own]
    want = Counter((name, *x) for name, _, _, rows in CASES for x in rows)
    batch = streaming.task_states(spark.createDataFrame(steps, STEPS), spark.createDataFrame(replies, REPLIES))
    assert Counter((r["session"], r["verdict"], r["status"]) for r in batch.collect()) == want
    steps.sort(key=lambda r: r[2])
    replies.sort(key=lambda r: r[1])
    # Each batch of files brings what happened up to a time; the last one carries the watermark past all limits.
    left = stream_of(spark, tmp_path / "steps", [*steps, command("zz", 0, 2 * 86_400)], STEPS, 1)
    right = stream_of(spark, tmp_path / "replies", [*replies, ("zz", FAR, "allow")], REPLIES, 1)
    got, states = run_stream(spark, streaming.task_states(left, right), tmp_path, "task")
    assert Counter((s, v, st) for s, _, v, st, _ in got if s != "zz") == want


def test_state_of_finished_tasks_goes(spark, tmp_path):
    rows = [command(f"s{i}", 0, i, action="done") for i in range(40)] + [command("open", 0, 50), command("zz", 0, 86_400), command("zz", 1, 2 * 86_400)]
    stream = stream_of(spark, tmp_path / "steps", rows, STEPS, len(rows) // 10)
    got, states = run_stream(spark, streaming.task_states(stream), tmp_path, "gone")
    assert sum(got.values()) == len(rows) and max(states) >= 20 and states[-1] == 2  # the open one, and the last


@pytest.mark.parametrize("batches", [1, 4])
def test_random_tasks_in_batch_and_stream(spark, tmp_path, batches):
    rng = random.Random(9)
    steps, replies = [], []
    for s in range(12):
        t = rng.uniform(0, 50)
        for i in range(30):
            t += rng.uniform(1, 20)
            risk, asks = rng.choice([None] * 6 + ["Pay"]), rng.random() < 0.1
            c = command(f"s{s}", i, round(t, 3), rng.choice(["click", "type", "scroll"]), f"el_{rng.randrange(2)}", risk, asks, None, rng.random() > 0.02, rng.choice(["", "x"]))
            steps.append((*c[:6], f"{c[3]}:{c[4]}:{c[5]}", *c[7:]))
            if risk or asks:
                t += rng.choice([5, 100, 130, 650])
                replies.append((f"s{s}", at(round(t, 3)), rng.choice(["allow", "fill", "refuse", "skip"])))
    batch = Counter(map(tuple, streaming.task_states(spark.createDataFrame(steps, STEPS), spark.createDataFrame(replies, REPLIES)).collect()))
    events = sorted(steps, key=lambda r: r[2])
    left = stream_of(spark, tmp_path / "steps", [*events, command("zz", 0, 2 * 86_400)], STEPS, 1)
    right = stream_of(spark, tmp_path / "replies", [*sorted(replies, key=lambda r: r[1]), ("zz", FAR, "allow")], REPLIES, 1)
    got, _ = run_stream(spark, streaming.task_states(left, right, forget_s=80_000), tmp_path, f"random{batches}")
    assert Counter({k: n for k, n in got.items() if k[0] != "zz"}) == batch


# WN-6, WN-7, WN-8


def test_ids_stay_when_a_page_is_seen_again(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(4)}", f"node{rng.randrange(30)}", at(i)) for i in range(400)]
    shape = "page string, node string, ts timestamp"
    want = Counter(tuple(r) for r in pages.first_seen_ids(spark.createDataFrame(rows, shape), ["page"], "node", "ts").select("page", "node", "id").collect())
    got, states = run_stream(spark, streaming.stable_ids(stream_of(spark, tmp_path / "seen", rows, shape, 6), "page", "node"), tmp_path, "ids")
    assert got == want and states[-1] == 4
    batch = streaming.stable_ids(spark.createDataFrame(rows, shape), "page", "node", prefix="f", start=1)
    assert Counter(tuple(r) for r in batch.collect()) == Counter((p, n, f"f{int(i[3:]) + 1}") for p, n, i in want)
