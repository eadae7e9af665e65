"""Agent sessions: numbering, history, repeats, targets, the policy gate, and outcomes.

A step log has session, step and a command struct (action, target, text, submit, direction, amountPx,
url, ms, summary, question, reason); elements come as an array per step.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from pagewarden.functions import text as T
from pagewarden.functions.pii import ascii_edges

# Words of the contract.
RISKY = (
    r"(?i)\b(log ?in|sign ?(in|up|on)|register|submit|send|pay|payment|buy|purchase|order|checkout|check ?out|delete|remove|confirm|transfer|book|subscribe|publish|post|place)\b"
)
PLACEHOLDER = r"\{\{?\s*([A-Za-z0-9_ .-]{1,40}?)\s*\}?\}"
MAX_REPEATS, MAX_STEPS, MOCK_STEPS = 2, 25, 5
COMMAND = "struct<action:string,target:string,text:string,submit:boolean,direction:string,amountPx:double,url:string,ms:bigint,summary:string,question:string,reason:string,reasoning:string,confidence:double>"
_VARIANT = ("action", "target", "text", "submit", "direction", "amountPx", "url", "ms", "summary", "question", "reason")


def number_steps(df: DataFrame, session: str, *order: str) -> DataFrame:
    """Adds step: 0, 1, ... within each session in the given order."""
    return df.withColumn("step", F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1)


def canonical(command: Column) -> Column:
    """The command as text without reasoning and confidence; equal texts are the same command."""
    return F.to_json(F.struct(*(command[k].alias(k) for k in _VARIANT)))


def _in_order(session: str = "session", step: str = "step"):
    return Window.partitionBy(session).orderBy(step)


def with_repeats(steps: DataFrame, same: Column, forgets: Column | None = None) -> DataFrame:
    """Adds is_repeat (equal to the command before), repeats (so far) and stopped (over the budget of two).

    ``same`` is what steps are compared by; ``forgets`` marks steps after which nothing counts as done
    before. A skipped repeat equals what it repeats, so the step before stands for the last one that ran.
    """
    w = _in_order()
    before = F.lag(same if forgets is None else F.when(~F.coalesce(forgets, F.lit(False)), same)).over(w)
    so_far = F.sum(F.col("is_repeat").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return steps.withColumn("is_repeat", F.coalesce(before == same, F.lit(False))).withColumn("repeats", so_far).withColumn("stopped", F.col("repeats") > MAX_REPEATS)


def in_tasks(steps: DataFrame, limit: int = MAX_STEPS) -> DataFrame:
    """Adds task_no: a session's steps in tasks of ``limit``, the most that a task has."""
    return steps.withColumn("task_no", F.floor(F.col("step") / limit).cast("int"))


def with_history(steps: DataFrame, value: Column, *task: str, out: str = "history") -> DataFrame:
    """Adds all that came before each step of its task, in order. Tasks have 25 steps at most; sessions that go on are cut by in_tasks()."""
    before = Window.partitionBy(*(task or ("session",))).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn(out, F.collect_list(value).over(before))


def with_clicked(steps: DataFrame) -> DataFrame:
    """Adds clicked: the distinct labels (else ids) of all targets clicked before each step of its session, in order of first click.

    ``steps`` has session, step, command, elements. A label counts from its first click on, and only first clicks
    are joined back, so no array grows with a session's steps, only with the labels on its pages.
    """
    c = F.col("command")
    name = F.coalesce(F.nullif(element_of(F.col("elements"), c["target"])["label"], F.lit("")), c["target"])
    firsts = steps.where(c["action"] == "click").groupBy("session", name.alias("_label")).agg(F.min("step").alias("_at"))
    of_session = firsts.where("_label IS NOT NULL").groupBy("session").agg(F.sort_array(F.collect_list(F.struct("_at", "_label"))).alias("_firsts"))
    known = F.filter(F.coalesce("_firsts", F.array().cast("array<struct<_at:int,_label:string>>")), lambda f: f["_at"] < F.col("step"))
    return steps.join(of_session, "session", "left").withColumn("clicked", F.transform(known, lambda f: f["_label"])).drop("_firsts")


def element_of(elements: Column, target: Column) -> Column:
    return F.get(F.filter(elements, lambda e: e["id"] == target), F.lit(0))


def clicked_labels(history: Column, elements: Column) -> Column:
    """Distinct labels (else ids) of clicked targets of a history, in order of first click."""
    clicks = F.filter(history, lambda c: c["action"] == "click")
    name = lambda t: F.coalesce(F.nullif(element_of(elements, t)["label"], F.lit("")), t)
    return F.array_distinct(F.transform(clicks, lambda c: name(c["target"])))


def known_target(elements: Column, target: Column) -> Column:
    return target.isNull() | F.array_contains(F.transform(elements, lambda e: e["id"]), target)


def describe_ids(elements: Column) -> Column:
    ids, n = F.transform(elements, lambda e: e["id"]), F.size(elements)
    return F.when(n == 0, "none (the page has no listed elements)").when(n <= 8, F.array_join(ids, ", ")).otherwise(F.concat(F.get(ids, F.lit(0)), F.lit(" .. "), F.element_at(ids, -1)))


def has_placeholder(text: Column) -> Column:
    return text.rlike(PLACEHOLDER)


def risky(command: Column, elements: Column) -> Column:
    """What a consequential command would do, null for harmless ones."""
    e = element_of(elements, command["target"])
    words = F.concat_ws(" ", e["label"], F.try_element_at(e["attributes"], F.lit("aria-label")), F.try_element_at(e["attributes"], F.lit("title")))
    name = F.coalesce(F.nullif(e["label"], F.lit("")), command["target"])
    risk = words.rlike(ascii_edges(RISKY)) | F.coalesce(F.try_element_at(e["attributes"], F.lit("type")) == "submit", F.lit(False))
    return F.when((command["action"] == "click") & risk, F.concat(F.lit('Click "'), name, F.lit('"'))).when(
        (command["action"] == "type") & F.coalesce(command["submit"], F.lit(False)), F.concat(F.lit('Type "'), command["text"], F.lit('" and submit the form'))
    )


def describe(command: Column, label: Column) -> Column:
    """A person's words for a command; a label over 40 characters is cut with an ellipsis."""
    short = F.when(F.length(label) > 40, F.concat(F.substring(label, 1, 39), F.lit("…"))).otherwise(label)
    target = F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit('"'), short, F.lit('"'))).otherwise(command["target"])
    submit = F.when(F.coalesce(command["submit"], F.lit(False)), " and submit").otherwise("")
    return (
        F.when(command["action"] == "click", F.concat(F.lit("Click "), target))
        .when(command["action"] == "type", F.concat(F.lit('Type "'), command["text"], F.lit('" into '), target, submit))
        .when(command["action"] == "scroll", F.concat(F.lit("Scroll "), command["direction"]))
        .when(command["action"] == "navigate", F.concat(F.lit("Go to "), command["url"]))
        .when(command["action"] == "wait", F.concat(F.lit("Wait "), command["ms"].cast("string"), F.lit(" ms")))
        .when(command["action"] == "done", F.concat(F.lit("Done: "), command["summary"]))
        .when(command["action"] == "ask_user", F.concat(F.lit("Question: "), command["question"]))
        .otherwise(F.concat(F.lit("Nothing to do: "), command["reason"]))
    )


def describe_past(command: Column, label: Column) -> Column:
    """The prompt's words for a past command."""
    named = F.when(F.coalesce(label, F.lit("")) != "", F.concat(command["target"], F.lit(' "'), T.ellipsis(label, 50), F.lit('"'))).otherwise(command["target"])
    submit = F.when(F.coalesce(command["submit"], F.lit(False)), " and submit").otherwise("")
    return (
        F.when(command["action"] == "click", F.concat(F.lit("click "), named))
        .when(command["action"] == "type", F.concat(F.lit('type "'), T.ellipsis(command["text"], 40), F.lit('" into '), named, submit))
        .when(command["action"] == "scroll", F.concat(F.lit("scroll "), command["direction"]))
        .when(command["action"] == "navigate", F.concat(F.lit("navigate to "), command["url"]))
        .when(command["action"] == "wait", F.concat(F.lit("wait "), command["ms"].cast("string"), F.lit(" ms")))
        .when(command["action"] == "done", F.concat(F.lit("done: "), T.ellipsis(command["summary"], 80)))
        .when(command["action"] == "ask_user", F.concat(F.lit("ask_user: "), T.ellipsis(command["question"], 80)))
        .otherwise(F.concat(F.lit("noop: "), T.ellipsis(command["reason"], 80)))
    )


def describe_viewer(command: Column, elements: Column) -> Column:
    """The viewer's words for a captured decision."""
    label = element_of(elements, command["target"])["label"]
    named = F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("“"), label, F.lit("”"))).otherwise(command["target"])
    typed = F.when(command["text"].contains("{{"), F.concat(F.lit("the saved "), command["text"])).otherwise(F.concat(F.lit("“"), command["text"], F.lit("”")))
    return (
        F.when(command["action"] == "click", F.concat(F.lit("Click "), named))
        .when(command["action"] == "type", F.concat(F.lit("Type "), typed, F.lit(" into "), named))
        .when(command["action"] == "scroll", F.concat(F.lit("Scroll "), command["direction"]))
        .when(command["action"] == "navigate", F.concat(F.lit("Go to "), command["url"]))
        .when(command["action"] == "wait", F.concat(F.lit("Wait "), command["ms"].cast("string"), F.lit(" ms")))
        .when(command["action"] == "done", command["summary"])
        .when(command["action"] == "ask_user", command["question"])
        .otherwise(F.coalesce(F.nullif(command["reason"], F.lit("")), F.lit("Nothing to do")))
    )


def _walk(batches):
    """A session's steps in order against what is remembered of it: adds is_repeat, repeats, is_skip to sorted rows.

    The last six columns are session, the command as text, and flags: lacks a saved detail, is an empty text, has
    a text from elsewhere, asks the user. A question leaves no command before the next step, nor does a field's first skip.
    """
    session, known, before, skipped, repeats = None, False, None, set(), 0
    for batch in batches:
        told = []
        for key, same, target, lacks, empty, foreign, asks in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 7, batch.num_columns))):
            if not known or key != session:
                session, known, before, skipped, repeats = key, True, None, set(), 0
            repeat = skip = False
            if lacks:
                before = None
            elif before is not None and same == before:
                repeat, repeats = True, repeats + 1
            elif empty:
                skip, before = True, same if target in skipped else None
                skipped.add(target)
            else:
                before = None if foreign or asks else same
            told.append((repeat, repeats, skip))
        columns = [pa.array(c, t) for c, t in zip(zip(*told), (pa.bool_(), pa.int32(), pa.bool_()))] if told else [pa.array([], t) for t in (pa.bool_(), pa.int32(), pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-7], *columns], names=[*batch.schema.names[:-7], "is_repeat", "repeats", "is_skip"])


def gate(steps: DataFrame, auto_confirm: bool = False) -> DataFrame:
    """Adds verdict (run, needs_user, stopped, skip_repeat, skip_field, confirm) and message to a step log, and is_repeat and repeats.

    ``steps`` has session, step, task, command, elements, and missing (names of placeholders without a
    saved value). First match decides: missing detail, repeat, empty text, text from elsewhere, risk. The
    command before is the last that ran; questions are taken as answered and risks as allowed. A session's
    steps pass one task in order, and only the last command, the skipped fields and the repeats are held.
    """
    c, els = F.col("command"), F.col("elements")
    e = element_of(els, c["target"])
    name = F.coalesce(F.nullif(e["label"], F.lit("")), c["target"])
    filled = F.try_element_at(e["attributes"], F.lit("filled"))
    no = lambda x: F.coalesce(x, F.lit(False))
    is_type = no(c["action"] == "type")
    empty = is_type & no(T.trim_all(c["text"]) == "") & (filled.isNull() | filled.isin("", "skipped"))
    foreign = is_type & ~no(has_placeholder(c["text"])) & ~F.coalesce(T.comes_from(c["text"], F.col("task")), F.lit(True))
    names = [f"c{i}" for i in range(len(steps.columns))]  # columns of any names
    marks = ["_session", "_same", "_target", "_lacks", "_empty", "_foreign", "_asks"]
    marked = steps.select("*", F.col("session").cast("string"), canonical(c), c["target"], no(F.size("missing") > 0), empty, foreign, no(c["action"] == "ask_user")).toDF(*names, *marks)
    at = {k: F.col(n) for k, n in zip(steps.columns, names)}
    ordered = marked.repartition("_session").sortWithinPartitions("_session", at["step"])
    shape = K.StructType([*(K.StructField(n, f.dataType) for n, f in zip(names, steps.schema)), K.StructField("is_repeat", K.BooleanType()), K.StructField("repeats", K.IntegerType()), K.StructField("is_skip", K.BooleanType())])
    s = ordered.mapInArrow(_walk, shape).toDF(*steps.columns, "is_repeat", "repeats", "is_skip")
    s = s.withColumn("what", describe(c, e["label"])).withColumn("risk", risky(c, els))
    # The messages of the contract.
    verdict = (
        F.when(F.size("missing") > 0, "needs_user")
        .when(F.col("is_repeat") & (F.col("repeats") <= MAX_REPEATS), "skip_repeat")
        .when(F.col("is_repeat"), "stopped")
        .when(F.col("is_skip"), "skip_field")
        .when(foreign, "needs_user")
        .when(F.col("risk").isNotNull() & ~F.lit(auto_confirm), "confirm")
        .otherwise("run")
    )
    message = (
        F.when(F.size("missing") > 0, F.concat(F.lit('The form asks for "'), name, F.lit('", but "'), F.array_join("missing", '", "'), F.lit('" is not saved.')))
        .when(F.col("is_repeat") & (F.col("repeats") <= MAX_REPEATS), F.concat(F.lit("Skipped a repeat of: "), F.col("what")))
        .when(F.col("is_repeat"), F.concat(F.lit("The agent kept proposing the same action ("), F.col("what"), F.lit("), so it was stopped.")))
        .when(F.col("is_skip"), F.concat(F.lit('Left "'), name, F.lit('" empty.')))
        .when(foreign, F.concat(F.lit('The agent wanted to type "'), c["text"], F.lit('", which is not in your task, so nothing was typed.')))
        .otherwise(F.col("risk"))
    )
    return s.withColumn("verdict", F.coalesce(verdict, F.lit("run"))).withColumn("message", message).drop("is_skip")


def select_elements(df: DataFrame, limit: int, elements: str = "elements") -> DataFrame:
    """Keeps at most ``limit`` elements, interactive and visible ones first, in their order; adds omitted. A limit of 0 keeps all."""
    e = F.col(elements)
    indexed = F.transform(e, lambda x, i: F.struct((~(x["isInteractive"] & x["isVisible"])).alias("late"), i.alias("i"), x.alias("e")))
    chosen = F.slice(F.array_sort(indexed, lambda a, b: F.when(a["late"] != b["late"], F.when(a["late"], 1).otherwise(-1)).otherwise(a["i"] - b["i"])), 1, max(limit, 1))
    back = F.transform(F.array_sort(chosen, lambda a, b: a["i"] - b["i"]), lambda x: x["e"])
    all_ = F.lit(limit <= 0) | (F.size(e) <= limit)
    return df.withColumn("omitted", F.when(all_, 0).otherwise(F.size(e) - limit)).withColumn(elements, F.when(all_, e).otherwise(back))


def mock_decision(elements: Column, step: Column) -> Column:
    """The baseline policy: done from step 5, else the first visible button (one that says submit first), else noop."""
    buttons = F.filter(elements, lambda e: (e["role"] == "button") & e["isInteractive"] & e["isVisible"])
    submit = F.filter(buttons, lambda e: F.contains(F.lower(e["label"]), F.lit("submit")))
    pick = F.coalesce(F.get(submit, F.lit(0)), F.get(buttons, F.lit(0)))
    done = F.struct(F.lit("done").alias("action"), F.lit(None).cast("string").alias("target"), F.lit("Mock reasoner stops after 5 steps.").alias("words"), F.lit(1.0).alias("confidence"))
    click = F.struct(F.lit("click").alias("action"), pick["id"].alias("target"), F.concat(F.lit("[mock] clicking first candidate button '"), pick["label"], F.lit("'")).alias("words"), F.lit(0.5).alias("confidence"))
    noop = F.struct(F.lit("noop").alias("action"), F.lit(None).cast("string").alias("target"), F.lit("[mock] no interactive button found in the sanitized context").alias("words"), F.lit(0.5).alias("confidence"))
    return F.when(step >= MOCK_STEPS, done).when(pick.isNotNull(), click).otherwise(noop)


def outcomes(log: DataFrame) -> DataFrame:
    """Per session: steps, last status, seconds, steps that targeted vision boxes, steps on listed elements.

    ``log`` has session, step, status, target, started_at and finished_at (timestamps).
    """
    vision = F.startswith(F.col("target"), F.lit("vis_"))
    return log.groupBy("session").agg(
        F.count("*").alias("steps"), F.max_by("status", "step").alias("status"), ((F.unix_millis(F.max("finished_at").cast("timestamp")) - F.unix_millis(F.min("started_at").cast("timestamp"))) / 1000.0).alias("seconds"),
        F.count_if(F.coalesce(vision, F.lit(False))).alias("vision_steps"), F.count_if(F.coalesce(~vision, F.lit(False))).alias("listed_steps"),
    )


def most_vision_only(captures: DataFrame, by: str, n: str) -> DataFrame:
    """Per group the capture id with the largest n; the first wins ties."""
    return captures.groupBy(by).agg(F.max_by("id", F.struct(F.col(n), -F.col("id"))).alias("id"), F.max(n).alias(n))


def field_fill(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per form: right of expected fields as n/m, and the wrong keys in order. Tables have form, key, value."""
    j = expected.join(actual.withColumnRenamed("value", "got"), ["form", "key"], "left").withColumn("ok", F.col("value").eqNullSafe(F.col("got")))
    return j.groupBy("form").agg(F.concat(F.count_if("ok").cast("string"), F.lit("/"), F.count("*").cast("string")).alias("filled"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("key")))).alias("wrong"))


def accepts_run(state: dict, started: int | None, finished: int | None) -> bool:
    """May a run begin, given what is held of its tab's runs so far? Runs come in the order they begin; None or NaN for unknown times."""
    if started is None or started != started:
        return True
    if state.get("open") or started < state.get("end", started):
        return False
    state.update({"open": True} if finished is None or finished != finished else {"end": int(finished)})
    return True


def overlapping_steps(runs: DataFrame) -> DataFrame:
    """Adds refused to runs (tab, started_at, finished_at): it began while the tab's last accepted run went on.

    A refused run blocks nobody. Runs of a tab pass one task in the order they begin, and nothing but the end of
    the last accepted one is held; a run without an end goes on, one without a beginning takes no part. Any other columns.
    """
    names = [f"c{i}" for i in range(len(runs.columns))]  # columns of any names
    us = [F.unix_micros(F.col(c).cast("timestamp")).alias(f"_{c}") for c in ("started_at", "finished_at")]
    keyed = runs.select("*", F.col("tab").cast("string").alias("_tab"), *us).toDF(*names, "_tab", "_started", "_finished")
    ordered = keyed.repartition("_tab").sortWithinPartitions("_tab", "_started", "_finished")

    def fold(batches):
        key, state = None, {}
        for batch in batches:
            refused = []
            for tab, started, finished in zip(*(batch.column(c).to_pylist() for c in ("_tab", "_started", "_finished"))):
                if tab != key:
                    key, state = tab, {}
                refused.append(not accepts_run(state, started, finished))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(refused, pa.bool_())], names=[*names, "refused"])

    shape = K.StructType([*(K.StructField(n, f.dataType) for n, f in zip(names, runs.schema)), K.StructField("refused", K.BooleanType())])
    return ordered.mapInArrow(fold, shape).toDF(*runs.columns, "refused")
