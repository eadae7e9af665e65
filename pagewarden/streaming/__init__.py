"""Streams of agent steps: sanitising, the task state machine, correlation by time, bounded and latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewarden.operators import captures as C
from pagewarden.streaming import keyed

APPROVAL_S, ANSWER_S, RING = keyed.APPROVAL_MS // 1000, keyed.ANSWER_MS // 1000, 30


def sanitise_stream(steps: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends every arriving step sanitised, those with an error too, to a table at ``path``."""
    return C.sanitise(steps).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def record_stream(steps: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append-only record of processed steps with latency or error; no row is dropped."""
    outcome = F.when(F.col("error").isNotNull(), "error").otherwise("ok")
    return steps.withColumn("outcome", outcome).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def _with_defaults(steps: DataFrame) -> DataFrame:
    given = {c: F.col(c) for c in steps.columns}
    null = F.lit(None).cast("string")
    return steps.select(
        F.col("session").alias("key"), F.col("seq").cast("long").alias("seq"), "ts", F.lit("command").alias("kind"), "action", "target", "text", "canonical", F.coalesce("filled", F.lit(False)).alias("filled"), "veto",
        F.coalesce("ok", F.lit(True)).alias("ok"), given.get("risk", null).alias("risk"), F.coalesce(given.get("asks", F.lit(False)), F.lit(False)).alias("asks"),
    )


def task_states(steps: DataFrame, replies: DataFrame | None = None, watermark: str = "10 minutes", forget_s: float = keyed.FORGET_MS / 1000) -> DataFrame:
    """The task state machine: a log row for every proposed command and every reply or time limit that counts, of streams or tables.

    ``steps`` has session (string), seq, ts, action, target, text, canonical (sessions.canonical), filled
    (the target holds something), veto (a status that ends the task, or null) and ok (execution
    succeeded); if it has risk (words, or null) such a command waits for an approval, and if it has asks, one
    with it for an answer. ``replies`` has session, ts and kind: allow, refuse, fill, skip, retry, stop.
    Skipped commands never count as the one before; the repeat budget of two is per task; done, ask_user
    and noop end it, as do the 25th step, 120 s without an approval and 600 s without an answer. A stream forgets a
    task ``forget_s`` after its end, so a command that comes later begins a new one; a table's is never forgotten.
    """
    events = _with_defaults(steps)
    if replies is not None:
        empty = {f.name: F.lit(None).cast(f.dataType) for f in events.schema}
        said = empty | {"key": F.col("session"), "ts": F.col("ts"), "kind": F.col("kind"), "seq": F.lit(2**31)}
        events = events.unionByName(replies.select(*(c.alias(n) for n, c in said.items())))
    return keyed.fold(events, keyed.Task(round(forget_s * 1000) if events.isStreaming else None), "seq", watermark=watermark)


def runs_one_at_a_time(runs: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(tab, started_at, finished_at, refused) of a stream of runs; over a table: sessions.overlapping_steps."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    events = runs.select(F.col("tab").alias("key"), F.col("started_at").alias("ts"), us("started_at").alias("started"), us("finished_at").alias("finished"))
    told = keyed.fold(events, keyed.OneAtATime(), "finished", watermark=watermark)
    return told.select("tab", F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("finished").alias("finished_at"), "refused")


def stable_ids(seen: DataFrame, scope: str, node: str, ts: str = "ts", prefix: str = "el_", start: int = 0, watermark: str = "10 minutes") -> DataFrame:
    """(scope, node, id) of each node when it is first seen in its scope, kept over batches; over a table: pages.first_seen_ids.

    Ids of elements and frames of a page or tab, and of vision cells (pages.vision_cell as node). A scope's memory is its nodes.
    """
    events = seen.select(F.col(scope).alias("key"), F.col(ts).alias("ts"), F.col(node).cast("string").alias("node"))
    return keyed.fold(events, keyed.StableIds(prefix, start), "node", watermark=watermark).toDF(scope, node, "id")


def match_within(left: DataFrame, right: DataFrame, keys: list[str], seconds: float, left_ts: str = "ts", right_ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Left rows with the right rows of their keys that came within ``seconds`` after them, else nulls.

    Works on streams and on tables: a frame's hello within 400 ms, an approval within 120 s, an answer
    within 600 s. Right columns are prefixed r_.
    """
    l = left.withWatermark(left_ts, watermark) if left.isStreaming else left  # noqa: E741
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    r = r.withWatermark(f"r_{right_ts}", watermark) if right.isStreaming else r
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    late = F.expr(f"r_{right_ts} >= {left_ts} AND r_{right_ts} <= {left_ts} + INTERVAL '{seconds}' SECOND")
    condition = late
    for s in same:
        condition = condition & s
    return l.join(r, condition, "left_outer")


def hello_frames(frames: DataFrame, hellos: DataFrame, by: str | None = None, limit: int = keyed.PARKED, watermark: str = "10 minutes") -> DataFrame:
    """Frames (nonce, tab, ts, and id if they have one) with read, and the frame that said hello (hellos: nonce, tab, ts, frame).

    A hello counts if it comes within 400 ms after the frame, or came before and was parked. ``by`` is the
    column of what parks them (a browser), which holds 256 at most; without it, each nonce is on its own.
    """
    null = F.lit(None).cast("string")

    def events(df: DataFrame, kind: str) -> DataFrame:
        text = {c: F.col(c).cast("string") if c in df.columns else null for c in ("id", "nonce", "tab", "frame")}
        return df.select(F.col(by or "nonce").cast("string").alias("key"), "ts", F.lit(kind).alias("kind"), *(c.alias(n) for n, c in text.items()))

    told = keyed.fold(events(frames, "frame").unionByName(events(hellos, "hello")), keyed.HelloDesk(limit), "kind", "id", watermark=watermark)
    return told.withColumnRenamed("key", by) if by and by not in ("nonce", "tab") else told.drop("key")


def approvals(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests (session, ts) with allowed: an answer of allow within 120 s; no answer is a refusal."""
    return match_within(requests, answers, ["session"], APPROVAL_S).withColumn("allowed", F.coalesce("r_allow", F.lit(False)))


def given_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions (session, ts) with outcome: the answer's kind within 600 s, else stop."""
    return match_within(questions, answers, ["session"], ANSWER_S).withColumn("outcome", F.coalesce("r_kind", F.lit("stop")))


def keep_ring(captures: DataFrame, path: str, checkpoint: str, by: str = "id", limit: int = RING, clear: str = "clear") -> StreamingQuery:
    """Keeps the newest ``limit`` captures of a stream at ``path``; read_ring() gives them.

    Each batch writes that bounded table anew, in a folder of its number, and then deletes all folders but this
    and the one before, from which a batch that is run again starts. If captures have a boolean column of the
    name ``clear``, a row with it empties the ring: of the batch's rows only those with a larger ``by`` stay.
    """

    def rewrite(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        files, folder = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path
        known = sorted(int(f.getPath().getName()) for f in (files.listStatus(folder(path)) if files.exists(folder(path)) else []) if f.getPath().getName().isdigit())
        before = [n for n in known if n < epoch]
        kept = batch
        if before:
            kept = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/{before[-1]}"))
        if clear in batch.columns:
            emptied = batch.where(F.col(clear)).agg(F.max(by)).first()[0]
            kept = kept if emptied is None else kept.where(F.col(by) > F.lit(emptied))
        kept.orderBy(F.desc(by)).limit(limit).write.mode("overwrite").parquet(f"{path}/{epoch}")
        for n in before[:-1]:
            files.delete(folder(f"{path}/{n}"), True)

    return captures.writeStream.foreachBatch(rewrite).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_ring(spark: SparkSession, path: str, by: str = "id") -> DataFrame:
    """The captures that keep_ring holds, newest first: the folder of the last batch that was finished."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = _files(spark, path)
    done = [int(f.getPath().getName()) for f in files.listStatus(folder(path)) if files.exists(folder(f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/{max(done)}").orderBy(F.desc(by))


def newest(captures: DataFrame, by: str = "id", limit: int = RING) -> DataFrame:
    """The last captures, newest first."""
    return captures.orderBy(F.desc(by)).limit(limit)


def latest_states(snapshots: DataFrame, key: str = "session", ts: str = "ts") -> DataFrame:
    """The last snapshot of each task; update mode on a stream."""
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*(c for c in snapshots.columns if c != key)), ts).alias("state"))
