"""The gate over a session step by step, against the state machine of the stream."""

import random

from pyspark.sql import functions as F

from pagewarden import streaming
from pagewarden.operators import sessions as S
from pagewarden.schema import ELEMENT


def test_gate_walks_like_the_stream(spark):
    rng, box = random.Random(21), (0.0, 0.0, 1.0, 1.0)
    # Fields are filled and empty by turns: an empty text that ran in a filled field may be proposed again when it is empty.
    held = lambda filled: [(f"el_{i}", "textbox", f"Field {i}", box, {"filled": "yes"} if filled[i] else None, True, True, None) for i in range(2)]
    rows = []
    for session in range(60):
        for step in range(25):
            action = rng.choice(["type", "type", "click", "scroll"])
            command = (action, f"el_{rng.randrange(2)}" if action != "scroll" else None, rng.choice(["", "", "tea"]) if action == "type" else None, "down" if action == "scroll" else None)
            rows.append((str(session), step, *command, held([rng.random() < 0.4 for _ in range(2)])))
    df = spark.createDataFrame(rows, f"session string, step int, action string, target string, text string, direction string, elements array<{ELEMENT}>")
    null = lambda t: F.lit(None).cast(t)
    command = F.struct(
        "action", "target", "text", null("boolean").alias("submit"), "direction", null("double").alias("amountPx"), null("string").alias("url"), null("bigint").alias("ms"), null("string").alias("summary"),
        null("string").alias("question"), null("string").alias("reason"), null("string").alias("reasoning"), null("double").alias("confidence"),
    ).cast(S.COMMAND)
    steps = df.withColumn("command", command).withColumn("task", F.lit("Look for tea")).withColumn("missing", F.array().cast("array<string>"))
    gated = {(r["session"], r["step"]): r["verdict"] for r in S.gate(steps).select("session", "step", "verdict").collect()}
    filled = F.coalesce(F.try_element_at(S.element_of(F.col("elements"), F.col("target"))["attributes"], F.lit("filled")) == "yes", F.lit(False))
    log = streaming.task_states(steps.select("session", F.col("step").alias("seq"), F.lit(0).alias("ts"), "action", "target", "text", S.canonical(F.col("command")).alias("canonical"), filled.alias("filled"), F.lit(None).cast("string").alias("veto"), F.lit(True).alias("ok")))
    seen = [r for r in log.collect() if r["verdict"] != "ignored"]
    assert {r["verdict"] for r in seen} == {"run", "skip_field", "skip_repeat", "stopped"}
    for r in seen:
        assert gated[(r["session"], r["step"])] == r["verdict"], r


def test_a_skip_after_an_empty_text_that_ran(spark):
    """An empty text runs in a filled field, is repeated when it is empty, and the field is skipped later: that is its first skip."""
    box = (0.0, 0.0, 1.0, 1.0)
    held = lambda filled: [("el_0", "textbox", "Field", box, {"filled": "yes"} if filled else None, True, True, None)]
    told = [("type", "", True), ("type", "", False), ("scroll", None, False), ("type", "", False), ("type", "", False), ("type", "", False)]
    rows = [("s", i, a, "el_0" if a == "type" else None, t, "down" if a == "scroll" else None, held(f)) for i, (a, t, f) in enumerate(told)]
    df = spark.createDataFrame(rows, f"session string, step int, action string, target string, text string, direction string, elements array<{ELEMENT}>")
    null = lambda t: F.lit(None).cast(t)
    command = F.struct(
        "action", "target", "text", null("boolean").alias("submit"), "direction", null("double").alias("amountPx"), null("string").alias("url"), null("bigint").alias("ms"), null("string").alias("summary"),
        null("string").alias("question"), null("string").alias("reason"), null("string").alias("reasoning"), null("double").alias("confidence"),
    ).cast(S.COMMAND)
    steps = df.withColumn("command", command).withColumn("task", F.lit("Look for tea")).withColumn("missing", F.array().cast("array<string>")).withColumn("other", F.lit("kept"))
    got = S.gate(steps).orderBy("step").collect()
    assert [r["verdict"] for r in got] == ["run", "skip_repeat", "run", "skip_field", "skip_field", "skip_repeat"] and got[0]["other"] == "kept"
