"""Ordered folds of a key's events with time limits, the same over a table and over a stream.

A machine remembers little about its key, takes the key's events in order of time and gives rows. Over a table
each key's events pass a task one after another, sorted by Spark, so that no key's events are held at once;
over a stream the machine's memory is keyed state with event-time timers. A limit that ends between two
events is acted on before the second; at the end of a table all limits have passed, as they have once a
stream's watermark is beyond them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewarden.operators import sessions as S

HELLO_MS, PARKED = 400, 256
APPROVAL_MS, ANSWER_MS, FORGET_MS = 120_000, 600_000, 600_000
TERMINAL = {"done": "done", "ask_user": "needs_user", "noop": "stopped"}


class Machine:
    """``columns`` are what step() reads of an event beside key and at (milliseconds); ``out`` is the shape of rows."""

    columns: tuple[str, ...] = ()
    out = ""

    def fresh(self) -> dict:
        return {}

    def step(self, key, state: dict, event) -> list[tuple]:
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        """When the next limit ends."""
        return None

    def expire(self, key, state: dict, at: int) -> list[tuple]:
        """Acts on the limits that end at ``at`` or before."""
        return []

    def is_over(self, state: dict) -> bool:
        """Is there nothing to remember?"""
        return not state


def _pass_limits(machine: Machine, key, state: dict, before: int | None) -> list[tuple]:
    """Limits that end before a time, or all of them."""
    out = []
    while (due := machine.due(state)) is not None and (before is None or due < before):
        out += machine.expire(key, state, due)
    return out


def _frame(machine: Machine, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in machine.out.split(", ")])


def over_table(events: DataFrame, machine: Machine, *order: str) -> DataFrame:
    """The machine's rows of a table of events (key, at, its columns)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, key, state = False, None, {}
        for batch in batches:
            out = []
            for e in batch.itertuples(index=False):
                if not known or e.key != key:
                    out += _pass_limits(machine, key, state, None) if known else []
                    known, key, state = True, e.key, machine.fresh()
                out += _pass_limits(machine, key, state, e.at)
                out += machine.step(key, state, e)
            yield _frame(machine, out)
        if known:
            yield _frame(machine, _pass_limits(machine, key, state, None))

    own = events.select("key", "at", *machine.columns, *(o for o in order if o not in machine.columns))
    return own.repartition("key").sortWithinPartitions("key", "at", *order).mapInPandas(walk, machine.out)


def over_stream(events: DataFrame, machine: Machine, *order: str) -> DataFrame:
    """The same for a stream whose watermark is set; state is kept as text and removed when there is nothing to remember."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = json.loads(state.get[0]) if state.exists else machine.fresh(), []
        if state.hasTimedOut:
            out += _pass_limits(machine, key[0], held, state.getCurrentWatermarkMs() + 1)
        else:
            for e in pd.concat(list(frames)).sort_values(["at", *order], kind="stable").itertuples(index=False):
                out += _pass_limits(machine, key[0], held, e.at)
                out += machine.step(key[0], held, e)
        if machine.is_over(held):
            state.remove()
        else:
            state.update((json.dumps(held),))
            if (due := machine.due(held)) is not None:
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield _frame(machine, out)

    own = events.select("key", "at", "ts", *machine.columns, *(o for o in order if o not in machine.columns))
    return own.groupBy("key").applyInPandasWithState(advance, machine.out, "memory string", "append", GroupStateTimeout.EventTimeTimeout)


def fold(events: DataFrame, machine: Machine, *order: str, watermark: str = "10 minutes") -> DataFrame:
    """Events of a table or a stream: key, ts (timestamp), the machine's columns; ``order`` decides between equal times. Events without a time come first."""
    timed = events.withColumn("key", F.col("key").cast("string")).withColumn("at", F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(0)))
    if events.isStreaming:
        return over_stream(timed.withWatermark("ts", watermark), machine, *order)
    return over_table(timed, machine, *order)


class HelloDesk(Machine):
    """Frames wait 400 ms for a hello of their nonce; up to 256 hellos that nobody waits for are parked and taken once.

    A hello from another tab than the frame's ends the wait unread. Where two frames wait for one nonce, the later has
    its hello, and the earlier's limit ends the later's wait for one too.
    """

    columns = ("kind", "id", "nonce", "tab", "frame")
    out = "key string, id string, nonce string, tab string, read boolean, frame string"

    def __init__(self, limit: int = PARKED, wait_ms: int = HELLO_MS):
        self.limit, self.wait_ms = limit, wait_ms

    def fresh(self) -> dict:
        return {"parked": {}, "waiting": [], "waiter": {}}

    def _told(self, key, frame, hello) -> tuple:
        read = hello is not None and hello[0] == frame[3]
        return key, frame[1], frame[2], frame[3], read, hello[1] if read else None

    def step(self, key, state, e):
        if e.kind == "frame":
            frame = [e.at + self.wait_ms, e.id, e.nonce, e.tab]
            if e.nonce in state["parked"]:
                return [self._told(key, frame, state["parked"].pop(e.nonce))]
            state["waiting"].append(frame)
            state["waiter"][e.nonce] = frame
        elif e.nonce in state["waiter"]:
            frame = state["waiter"].pop(e.nonce)
            state["waiting"].remove(frame)
            return [self._told(key, frame, (e.tab, e.frame))]
        elif len(state["parked"]) < self.limit:
            state["parked"][e.nonce] = [e.tab, e.frame]
        return []

    def due(self, state):
        return min((f[0] for f in state["waiting"]), default=None)

    def expire(self, key, state, at):
        gone = [f for f in state["waiting"] if f[0] <= at]
        state["waiting"] = [f for f in state["waiting"] if f[0] > at]
        for f in gone:
            state["waiter"].pop(f[2], None)
        return [self._told(key, f, None) for f in gone]

    def is_over(self, state):
        return not state["parked"] and not state["waiting"]


class Task(Machine):
    """An agent's task: repeats, skipped fields, vetoes, approvals and questions with their limits, 25 steps.

    Statuses: running, confirm (a risk waits 120 s for allow; else the task stops), input (a question waits
    600 s for an answer; else it stops), and what ends a task. Commands that come while one waits, or after
    the end, are ignored; replies that nothing waits for as well, without a row. With ``forget_ms`` a finished
    task is forgotten that long after its end.
    """

    columns = ("kind", "action", "target", "text", "canonical", "filled", "veto", "ok", "risk", "asks")
    out = "session string, step int, verdict string, status string, repeats int"

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def fresh(self) -> dict:
        return {"step": 0, "repeats": 0, "previous": None, "status": "running", "skipped": [], "limit": None, "pending": None}

    def step(self, key, state, e):
        if e.kind == "command":
            return self._command(key, state, e)
        waits = {"allow": "confirm", "refuse": "confirm", "fill": "input", "skip": "input", "retry": "input"}.get(e.kind)
        if e.kind != "stop" and waits != state["status"] or state["status"] not in ("running", "confirm", "input"):
            return []
        pending, state["pending"], state["limit"] = state["pending"], None, None
        if e.kind in ("stop", "refuse"):
            return self._end(key, state, "stopped" if e.kind == "stop" else "refused", "stopped", e.at)
        state["status"] = "running"
        if e.kind == "allow":
            return self._ran(key, state, pending, e.at)
        state["previous"] = None
        if e.kind == "skip" and pending["target"] not in state["skipped"]:
            state["skipped"].append(pending["target"])
        return self._row(key, state, "answered", e.at)

    def _command(self, key, state, e):
        if state["status"] != "running":
            return [(key, state["step"], "ignored", state["status"], state["repeats"])]
        state["step"] += 1
        if state["previous"] is not None and e.canonical == state["previous"]:
            if state["repeats"] >= S.MAX_REPEATS:
                return self._end(key, state, "stopped", "stopped", e.at)
            state["repeats"] += 1
            return self._row(key, state, "skip_repeat", e.at)
        if e.action == "type" and not (e.text or "").strip() and not e.filled:
            again = e.target in state["skipped"]
            state["previous"] = e.canonical if again else None
            if not again:
                state["skipped"].append(e.target)
            return self._row(key, state, "skip_field", e.at)
        if e.veto:
            return self._end(key, state, "vetoed", e.veto, e.at)
        pending = {"action": e.action, "target": e.target, "canonical": e.canonical, "ok": bool(e.ok)}
        if e.asks or e.risk:
            state["status"], wait = ("input", ANSWER_MS) if e.asks else ("confirm", APPROVAL_MS)
            state["pending"], state["limit"] = pending, e.at + wait
            return [(key, state["step"] - 1, "asked", state["status"], state["repeats"])]
        return self._ran(key, state, pending, e.at)

    def _ran(self, key, state, command, at):
        if not command["ok"]:
            return self._end(key, state, "failed", "failed", at)
        state["previous"] = command["canonical"]
        if command["action"] in TERMINAL:
            return self._end(key, state, "run", TERMINAL[command["action"]], at)
        return self._row(key, state, "run", at)

    def _row(self, key, state, verdict, at):
        if state["status"] == "running" and state["step"] >= S.MAX_STEPS:
            return self._end(key, state, verdict, "max_steps", at)
        return [(key, state["step"] - 1, verdict, state["status"], state["repeats"])]

    def _end(self, key, state, verdict, status, at):
        state["status"], state["pending"], state["limit"] = status, None, None if self.forget_ms is None else at + self.forget_ms
        return [(key, max(state["step"] - 1, 0), verdict, status, state["repeats"])]

    def due(self, state):
        return state.get("limit")

    def expire(self, key, state, at):
        if state["status"] in ("confirm", "input"):
            return self._end(key, state, "refused" if state["status"] == "confirm" else "unanswered", "stopped", at)
        state.update(self.fresh())
        return []

    def is_over(self, state):
        return state == self.fresh()


class OneAtATime(Machine):
    """Runs of a tab in the order they begin: one that begins before the last accepted one's end is refused, and blocks nobody.

    A run without an end goes on; one without a beginning takes no part and is not refused. Times are microseconds.
    """

    columns = ("started", "finished")
    out = "tab string, started long, finished long, refused boolean"

    def step(self, key, state, e):
        ok = S.accepts_run(state, e.started, e.finished)
        return [(key, *(None if pd.isna(x) else int(x) for x in (e.started, e.finished)), not ok)]

    def due(self, state):
        return None if state.get("open") or "end" not in state else state["end"] // 1000 + 1

    def expire(self, key, state, at):
        state.clear()
        return []


class StableIds(Machine):
    """Numbers a key's nodes in the order of their first sight, for as long as the key lives; a row for each new node."""

    columns = ("node",)
    out = "key string, node string, id string"

    def __init__(self, prefix: str = "", start: int = 0):
        self.prefix, self.start = prefix, start

    def step(self, key, state, e):
        if e.node in state:
            return []
        state[e.node] = len(state) + self.start
        return [(key, e.node, f"{self.prefix}{state[e.node]}")]
