"""Queries over steps, runs and replies derived from events, and captures derived from conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden import schema, streaming
from pagewarden.functions import boxes as B
from pagewarden.operators import captures as C
from pagewarden.operators import pages as P
from pagewarden.operators import profile, replies
from pagewarden.operators import sessions as S
from pagewarden.plans import views
from pagewarden.plans.views import STEPS, duck

NAMES = ("Search", "Submit order", "Home")


def _steps(spark, sf):
    return views.run(spark, sf, STEPS)


def _element(i: int, role: str, label: str) -> Column:
    box = B.box(F.lit(40.0 * i), F.lit(30.0 * i), F.lit(30.0), F.lit(20.0))
    return F.struct(F.lit(f"el_{i}").alias("id"), F.lit(role).alias("role"), F.lit(label).alias("label"), box.alias("bbox"), F.create_map(F.lit("type"), F.lit("submit" if i == 1 else "text")).alias("attributes"), F.lit(True).alias("isVisible"), F.lit(i != 2).alias("isInteractive"), F.lit(None).cast("boolean").alias("redacted"))


def _elements() -> Column:
    roles = ("textbox", "button", "link")
    return F.array(*(_element(i, roles[i], NAMES[i]) for i in range(3))).cast(f"array<{schema.ELEMENT}>")


def _command(action: Column, target: Column, text: Column) -> Column:
    typed = F.when(action == "type", text)
    return F.struct(
        action.alias("action"), target.alias("target"), typed.alias("text"), F.lit(None).cast("boolean").alias("submit"), F.when(action == "scroll", "down").alias("direction"), F.lit(None).cast("double").alias("amountPx"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("bigint").alias("ms"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("question"),
        F.when(action == "noop", "wait").alias("reason"), F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("double").alias("confidence"),
    ).cast(S.COMMAND)


def _commands(spark, sf):
    text = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "cheap flights").when(F.col("event_id") % 4 == 2, "{{email}}").otherwise("hotels")
    s = _steps(spark, sf).withColumn("command", _command(F.col("action"), F.col("target"), text))
    missing = F.when((F.col("action") == "type") & (F.col("event_id") % 8 == 2), F.array(F.lit("email"))).otherwise(F.array().cast("array<string>"))
    return s.withColumn("missing", missing).withColumn("task", F.lit("Search for cheap flights")).withColumn("elements", _elements())


def session_steps(spark, sf):
    return S.number_steps(views.table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", F.col("step").cast("int").alias("step"))


def session_repeats(spark, sf):
    same = F.concat_ws(":", "action", F.coalesce("target", F.lit("")))
    return S.with_repeats(_steps(spark, sf), same, F.col("action") == "noop").select("session", "step", "is_repeat", "repeats", "stopped")


def session_history(spark, sf):
    """A session's steps in tasks of 25, as a task has at most, with all commands before each."""
    tasks = S.in_tasks(_steps(spark, sf))
    return S.with_history(tasks, F.col("action"), "session", "task_no").select("session", "step", F.array_join("history", ",").alias("history"))


def clicked_labels(spark, sf):
    """The labels clicked in the whole session before each step."""
    return S.with_clicked(_commands(spark, sf)).select("session", "step", F.array_join("clicked", ", ").alias("clicked"))


def session_outcomes(spark, sf):
    s = _steps(spark, sf)
    vis = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("vis_"), F.col("event_id").cast("string"))).otherwise(F.col("target"))
    log = s.select("session", "step", F.col("action").alias("status"), vis.alias("target"), F.col("ts").alias("started_at"), (F.col("ts") + F.expr("INTERVAL 2 SECONDS")).alias("finished_at"))
    return S.outcomes(log)


def policy_gate(spark, sf):
    return S.gate(_commands(spark, sf)).select("session", "step", "verdict", "message")


def mock_policy(spark, sf):
    d = _commands(spark, sf).select(S.mock_decision(F.col("elements"), F.col("step")).alias("d"))
    return d.groupBy(F.col("d.action").alias("action"), F.col("d.target").alias("target"), F.col("d.words").alias("words")).agg(F.count("*").alias("n"))


def kept_elements(spark, sf):
    s = _commands(spark, sf).withColumn("elements", F.when(F.col("event_id") % 2 == 0, F.reverse("elements")).otherwise(F.col("elements")))
    k = S.select_elements(s, 2)
    return k.groupBy(F.array_join(F.transform("elements", lambda e: e["id"]), ",").alias("kept"), "omitted").agg(F.count("*").alias("n"))


def target_hints(spark, sf):
    t = F.when(F.col("event_id") % 3 == 0, F.lit("el_9")).otherwise(F.col("target"))
    c = _commands(spark, sf).withColumn("t", t)
    known = S.known_target(F.col("elements"), F.col("t"))
    return c.select("session", "step", known.alias("known"), F.when(~known, S.describe_ids(F.col("elements"))).alias("hint"), S.element_of(F.col("elements"), F.col("t"))["label"].alias("label"))


def risky_actions(spark, sf):
    c = _commands(spark, sf).select("session", "step", S.risky(F.col("command"), F.col("elements")).alias("risk"))
    return c.groupBy("risk").agg(F.count("*").alias("n"))


def described(spark, sf):
    c = _commands(spark, sf)
    label = S.element_of(F.col("elements"), F.col("command.target"))["label"]
    words = c.select(S.describe(F.col("command"), label).alias("popup"), S.describe_past(F.col("command"), label).alias("prompt"), S.describe_viewer(F.col("command"), F.col("elements")).alias("viewer"))
    return words.groupBy("popup", "prompt", "viewer").agg(F.count("*").alias("n"))


def task_log(spark, sf):
    """The state machine over all sessions; the same operator runs on streams."""
    c = _commands(spark, sf)
    rows = c.select(F.col("session").cast("string").alias("session"), F.col("step").alias("seq"), "ts", "action", "target", F.col("command.text").alias("text"), S.canonical(F.col("command")).alias("canonical"), F.lit(False).alias("filled"), F.when(F.size("missing") > 0, "needs_user").alias("veto"), F.lit(True).alias("ok"))
    return streaming.task_states(rows)


def _hello_events(spark, sf):
    """Each two events are a frame and its hello, seconds apart either way; one in eleven comes from another tab."""
    e = views.table(spark, sf, "events")
    pair = F.floor(F.col("event_id") / 2)
    at = F.timestamp_millis(pair * 5000 + F.when(F.col("event_id") % 2 == 1, (F.col("event_id") * 37) % 1900 - 950).otherwise(0))
    return e.select("event_id", (F.floor(pair / 400) % 5).alias("browser"), pair.alias("nonce"), F.when((F.col("event_id") % 22) == 1, 9).otherwise(1).alias("tab"), at.alias("ts"))


def frame_hellos(spark, sf):
    """Frames with the hello that reads them: one parked before, or one within 400 ms."""
    e = _hello_events(spark, sf)
    frames = e.where("event_id % 2 = 0").withColumn("id", F.col("event_id"))
    hellos = e.where("event_id % 2 = 1").withColumn("frame", F.col("event_id"))
    r = streaming.hello_frames(frames, hellos, by="browser")
    return r.select(F.col("id").cast("long").alias("event_id"), "read", F.col("frame").cast("long").alias("hello_id"))


def latest_states(spark, sf):
    e = views.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    ordered = e.withColumn("at", F.struct("ts", "event_id"))
    s = streaming.latest_states(ordered, "user_id", "at")
    return s.select("user_id", F.col("state.event_id").alias("event_id"), F.col("state.event_type").alias("event_type"))


def newest_captures(spark, sf):
    return streaming.newest(views.table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type"))


def refused_runs(spark, sf):
    e = views.table(spark, sf, "events")
    runs = e.select(F.col("user_id").alias("tab"), F.col("ts").alias("started_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"))
    return S.overlapping_steps(runs).groupBy("tab").agg(F.count("*").alias("runs"), F.count_if("refused").alias("refused"))


def first_seen(spark, sf):
    e = views.table(spark, sf, "events").withColumn("tab", F.col("user_id") % 50).withColumn("frame", F.col("user_id"))
    return P.first_seen_ids(e, ["tab"], "frame", "ts", "event_id", prefix="f", start=1)


def _captures(spark, sf):
    c = views.table(spark, sf, "conversations")
    redaction = F.struct(B.box(F.lit(10.0), F.lit(20.0), F.lit(80.0), F.lit(30.0)).alias("bbox"), F.when(F.col("turn") % 2 == 0, "face").otherwise("email").alias("category"), F.lit(0.9).alias("confidence"), F.when(F.col("turn") % 2 == 0, "ml").otherwise("heuristic").alias("method"))
    shot = F.when(F.col("turn") % 2 == 0, F.struct(F.lit("image/png").alias("mimeType"), F.lit("aGk=").alias("dataBase64"), F.lit(640).alias("width"), F.lit(480).alias("height")))
    return c.select(
        F.when(F.col("conv_id") % 7 == 0, "1.0.0").otherwise("0.1.0").alias("protocolVersion"), F.col("conv_id").cast("string").alias("sessionId"), F.col("turn").cast("int").alias("stepIndex"), F.col("text").alias("task"),
        F.struct(F.concat(F.lit("https://chat.example.org/c/"), F.col("conv_id").cast("string"), F.lit("?turn="), F.col("turn").cast("string")).alias("url"), F.substring("text", 1, 60).alias("title"), F.lit("2026-01-01T00:00:00Z").alias("capturedAt")).alias("page"),
        F.struct(F.lit(640.0).alias("width"), F.lit(480.0).alias("height"), F.lit(0.0).alias("scrollX"), F.lit(0.0).alias("scrollY"), F.lit(2.0).alias("devicePixelRatio")).alias("viewport"),
        _elements().alias("elements"), shot.alias("screenshot"), F.array(redaction).cast(f"array<{schema.REGION}>").alias("redactions"), F.array(_command(F.lit("click"), F.lit("el_1"), F.lit(None).cast("string"))).alias("history"),
        F.struct(F.lit("m").alias("modelId"), F.lit(12.0).alias("latencyMs")).alias("perception"), F.col("text").alias("pageText"), F.array(F.struct(F.lit("email").alias("key"), F.lit("Email").alias("label"))).alias("profileFields"),
    )


def sanitised_captures(spark, sf):
    c = C.sanitise(_captures(spark, sf))
    r = F.get("redactions", F.lit(0))
    return c.select("sessionId", "stepIndex", F.col("page.url").alias("url"), F.size("redactions").alias("regions"), r["bbox"]["x"].alias("x"), r["bbox"]["y"].alias("y"), r["bbox"]["width"].alias("width"), r["bbox"]["height"].alias("height"))


def sanitised_texts(spark, sf):
    return C.sanitise(_captures(spark, sf)).select("sessionId", "stepIndex", F.col("page.title").alias("title"), "pageText")


def capture_violations(spark, sf):
    c = _captures(spark, sf).withColumn("stepIndex", F.when(F.col("stepIndex") == 3, -1).otherwise(F.col("stepIndex")))
    valid, rejects = C.split_valid(c)
    return rejects.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n")).unionByName(valid.agg(F.lit("").alias("violations"), F.count("*").alias("n")))


def action_prompts(spark, sf):
    return C.action_prompt(C.sanitise(_captures(spark, sf)), 2).select("sessionId", "stepIndex", "prompt")


def question_prompts(spark, sf):
    return C.question_prompt(C.sanitise(_captures(spark, sf))).select("sessionId", "stepIndex", "prompt")


#: Shapes of replies: (raw, action and target it stands for, or the start of the reason it is rejected for)
SHAPES = (
    ('{"action": "toggle", "target": "el_2", "reasoning": "open the start page"}', "click", "el_2"),
    ('My choice:\n```json\n{"action": "left-click", "selector": "#2"}\n```\nThat should do.', "click", "el_2"),
    ('{"action": "select", "target": "order"}', "click", "el_1"),
    ('{"output": {"data": {"action": "go_to", "link": "https://shop.example.net/cart"}}}', "navigate", None),
    ('{"action": "press elem 0"}', "click", "el_0"),
    ("{'action': 'set_value', 'element': 'Search', 'content': 'tea', 'hit_enter': 'on'}", "type", "el_0"),
    ('[3, {"action": "pause", "duration": 750,}]', "wait", None),
    ('{"action": "scroll up", "px": 120}', "scroll", None),
    ('{"summary": "Basket is ready"}', "done", None),
    ('{"action": "clarify", "content": "Which size?"}', "ask_user", None),
    ('{"action": "idle", "why": "page still loads"}', "noop", None),
    ('{"index": 0, "keys": "green tea"}', "type", "el_0"),
    ('{"href": "/help"}', "navigate", None),
    ("   ", "model returned", None),
    ("Let me think about the page first", "no JSON object", None),
    ('{"action": "hover", "target": "el_1"}', "unknown action", None),
    ('{"action": "tap", "target": "Gift wrap"}', "unknown target", None),
    ('{"action": "load"}', "navigate.url:", None),
)
_USABLE = 13


def _replies(spark, sf):
    raw = F.element_at(F.array(*(F.lit(s[0]) for s in SHAPES)), (F.col("event_id") % len(SHAPES) + 1).cast("int"))
    return views.table(spark, sf, "events").select("event_id", raw.alias("raw")).withColumn("elements", _elements())


def commands(spark, sf):
    n = replies.normalise(_replies(spark, sf))
    short = F.when(F.col("reject").isNull(), F.col("command.action")).otherwise(F.array_join(F.slice(F.split("reject", " "), 1, F.when(F.startswith(F.col("reject"), F.lit("no ")), 3).when(F.contains(F.col("reject"), F.lit("url")), 1).otherwise(2)), " "))
    return n.select("event_id", short.alias("outcome"), F.col("command.target").alias("target"))


def reply_attempts(spark, sf):
    r = _replies(spark, sf).withColumn("step", F.floor(F.col("event_id") / 2)).withColumn("attempt", F.col("event_id") % 2 + 1)
    got = replies.resolve_attempts(replies.normalise(r), "step")
    return got.select("step", F.col("command.action").alias("action"), "failed", F.size("raws").alias("raws"))


def people_picked(spark, sf):
    tasks = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"), F.concat(F.lit("Fill the form for "), F.when(F.col("c_custkey") % 3 == 0, F.lit("my father's account")).when(F.col("c_custkey") % 3 == 1, F.lit("Aunt May")).otherwise(F.lit("me")), F.lit(".")).alias("task"))
    people = spark.createDataFrame([(1, "Me", True, 0), (2, "Father", False, 1), (3, "May", False, 2), (4, "Aunt May", False, 3)], "person_id int, name string, active boolean, pos int").coalesce(1)
    return profile.pick_person(tasks, people)


def placeholders(spark, sf):
    c = views.table(spark, sf, "customer")
    texts = c.select(F.col("c_custkey").alias("text_id"), F.concat(F.lit("Hi {{Full Name}}, {email} or {{ phone }}; no. "), F.col("c_custkey").cast("string")).alias("text"))
    fields = spark.createDataFrame([("full_name", "Name", "Ann Lee", "text", 0), ("mail", "Email", "a@b.c", "text", 1), ("phone", "Phone", " ", "text", 2)], "key string, label string, value string, kind string, pos int").coalesce(1)
    r = profile.resolve(texts, fields)
    return r.select("text_id", "resolved", F.array_join("used", ",").alias("used"), F.array_join("missing", ",").alias("missing"))


def saved_answers(spark, sf):
    c = views.table(spark, sf, "customer")
    fields = c.select(F.col("c_nationkey").cast("int").alias("person_id"), F.concat(F.lit("c_"), (F.col("c_custkey") % 5).cast("string")).alias("key")).distinct().select("person_id", "key", F.upper("key").alias("label"), F.lit("old").alias("value"), F.lit("text").alias("kind"))
    answers = c.select(F.col("c_nationkey").cast("int").alias("person_id"), F.concat(F.lit("C "), (F.col("c_custkey") % 7).cast("string"), F.lit(" (optional) *")).alias("label"), F.col("c_custkey").cast("string").alias("value"), F.col("c_custkey").alias("seq"))
    return profile.save_answers(fields, answers)


def group_fill(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("grp"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("x").alias("value"))
    return profile.group_fill(o)


QUERIES = {f.__name__: f for f in (
    session_steps, session_repeats, session_history, clicked_labels, session_outcomes, policy_gate, mock_policy, kept_elements, target_hints, risky_actions, described, task_log,
    frame_hellos, latest_states, newest_captures, refused_runs, first_seen, sanitised_captures, sanitised_texts, capture_violations, action_prompts, question_prompts, commands,
    reply_attempts, people_picked, placeholders, saved_answers, group_fill,
)}

_S = f"({duck(STEPS)})"
_OUT = ", ".join(f"({i}, '{a}', {'NULL' if t is None else repr(t)})" for i, (_, a, t) in enumerate(SHAPES))
_LABEL = "CASE target WHEN 'el_0' THEN 'Search' WHEN 'el_1' THEN 'Submit order' WHEN 'el_2' THEN 'Home' END"
_TEXT = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'cheap flights' WHEN 2 THEN '{{email}}' ELSE 'hotels' END"

ORACLE_SQL = {
    "session_steps": "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS step FROM events",
    "session_repeats": f"""WITH s AS (SELECT *, concat(action, ':', coalesce(target, '')) AS k FROM {_S}),
      r AS (SELECT session, step, coalesce(lag(CASE WHEN action <> 'noop' THEN k END) OVER (PARTITION BY session ORDER BY step) = k, false) AS is_repeat FROM s),
      c AS (SELECT *, sum(is_repeat::INT) OVER (PARTITION BY session ORDER BY step)::INT AS repeats FROM r) SELECT *, repeats > 2 AS stopped FROM c""",
    "session_history": f"SELECT session, step, coalesce(string_agg(action, ',') OVER (PARTITION BY session, step // 25 ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM {_S}",
    "clicked_labels": f"""WITH s AS (SELECT session, step, CASE WHEN action = 'click' THEN {_LABEL} END AS label FROM {_S}),
      f AS (SELECT s.session, s.step, b.label, min(b.step) AS clicked_at FROM s JOIN s b ON b.session = s.session AND b.step < s.step WHERE b.label IS NOT NULL GROUP BY ALL),
      g AS (SELECT session, step, string_agg(label, ', ' ORDER BY clicked_at) AS clicked FROM f GROUP BY session, step)
      SELECT session, step, coalesce(clicked, '') AS clicked FROM s LEFT JOIN g USING (session, step)""",
    "session_outcomes": f"""WITH s AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN concat('vis_', event_id) ELSE target END AS t FROM {_S})
      SELECT session, count(*) AS steps, max_by(action, step) AS status, (epoch_us(max(ts) + INTERVAL 2 SECOND) // 1000 - epoch_us(min(ts)) // 1000) / 1000.0::DOUBLE AS seconds,
             count(*) FILTER (starts_with(t, 'vis_')) AS vision_steps, count(*) FILTER (NOT starts_with(t, 'vis_')) AS listed_steps FROM s GROUP BY session""",
    # The steps of each session one after another, with what the session remembers: the last command that ran, the fields skipped, the repeats.
    "policy_gate": f"""WITH RECURSIVE s AS (SELECT *, {_LABEL} AS label, CASE WHEN action = 'type' THEN {_TEXT} END AS text, action = 'type' AND event_id % 8 = 2 AS miss FROM {_S}),
      q AS (SELECT *, concat_ws('|', action, target, text) AS k,
              CASE action WHEN 'click' THEN 'Click "' || label || '"' WHEN 'type' THEN 'Type "' || text || '" into "' || label || '"' WHEN 'scroll' THEN 'Scroll down' ELSE 'Nothing to do: wait' END AS what FROM s),
      walk AS (
        SELECT session, -1 AS step, NULL::VARCHAR AS previous, []::VARCHAR[] AS skipped, 0 AS n, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT session FROM q)
        UNION ALL
        SELECT session, step, CASE verdict WHEN 'needs_user' THEN NULL WHEN 'skip_field' THEN CASE WHEN list_contains(skipped, target) THEN k END WHEN 'run' THEN k WHEN 'confirm' THEN k ELSE previous END,
               CASE WHEN verdict = 'skip_field' THEN list_append(skipped, target) ELSE skipped END, CASE WHEN verdict IN ('skip_repeat', 'stopped') THEN n + 1 ELSE n END, verdict
        FROM (SELECT q.*, w.previous, w.skipped, w.n,
                CASE WHEN q.miss THEN 'needs_user' WHEN w.previous = q.k AND w.n < 2 THEN 'skip_repeat' WHEN w.previous = q.k THEN 'stopped' WHEN q.text = '' THEN 'skip_field' WHEN q.text = 'hotels' THEN 'needs_user'
                     WHEN q.action = 'click' AND q.target = 'el_1' THEN 'confirm' ELSE 'run' END AS verdict
              FROM walk w JOIN q ON q.session = w.session AND q.step = w.step + 1))
      SELECT q.session, q.step, verdict,
        CASE WHEN miss THEN 'The form asks for "' || label || '", but "email" is not saved.' WHEN verdict = 'skip_repeat' THEN 'Skipped a repeat of: ' || what
             WHEN verdict = 'stopped' THEN 'The agent kept proposing the same action (' || what || '), so it was stopped.' WHEN text = '' THEN 'Left "' || label || '" empty.'
             WHEN text = 'hotels' THEN 'The agent wanted to type "hotels", which is not in your task, so nothing was typed.' WHEN action = 'click' AND target = 'el_1' THEN 'Click "Submit order"' END AS message
      FROM walk JOIN q USING (session, step)""",
    "task_log": f"""WITH RECURSIVE s AS (SELECT *, CASE WHEN action = 'type' THEN {_TEXT} END AS text, action = 'type' AND event_id % 8 = 2 AS miss FROM {_S}),
      q AS (SELECT *, concat_ws('|', action, target, text) AS k FROM s),
      walk AS (
        SELECT session, -1 AS place, 0 AS step, NULL::VARCHAR AS previous, []::VARCHAR[] AS skipped, 0 AS repeats, 'running' AS status, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT session FROM q)
        UNION ALL
        SELECT session, place, CASE WHEN verdict = 'ignored' THEN was ELSE was + 1 END, CASE verdict WHEN 'skip_field' THEN CASE WHEN list_contains(skipped, target) THEN k END WHEN 'run' THEN k ELSE previous END,
               CASE WHEN verdict = 'skip_field' AND NOT list_contains(skipped, target) THEN list_append(skipped, target) ELSE skipped END, CASE WHEN verdict = 'skip_repeat' THEN repeats + 1 ELSE repeats END,
               CASE WHEN verdict = 'ignored' THEN status WHEN verdict = 'stopped' THEN 'stopped' WHEN verdict = 'vetoed' THEN 'needs_user' WHEN verdict = 'run' AND action = 'noop' THEN 'stopped' WHEN was + 1 >= 25 THEN 'max_steps' ELSE 'running' END, verdict
        FROM (SELECT q.session, q.step AS place, q.k, q.target, q.action, w.step AS was, w.previous, w.skipped, w.repeats, w.status,
                CASE WHEN w.status <> 'running' THEN 'ignored' WHEN w.previous = q.k AND w.repeats < 2 THEN 'skip_repeat' WHEN w.previous = q.k THEN 'stopped' WHEN q.text = '' THEN 'skip_field' WHEN q.miss THEN 'vetoed' ELSE 'run' END AS verdict
              FROM walk w JOIN q ON q.session = w.session AND q.step = w.place + 1))
      SELECT session::VARCHAR AS session, (CASE WHEN verdict = 'ignored' THEN step ELSE step - 1 END)::INT AS step, verdict, status, repeats::INT AS repeats FROM walk WHERE place >= 0""",
    "mock_policy": f"""SELECT CASE WHEN step >= 5 THEN 'done' ELSE 'click' END AS action, CASE WHEN step < 5 THEN 'el_1' END AS target,
      CASE WHEN step >= 5 THEN 'Mock reasoner stops after 5 steps.' ELSE '[mock] clicking first candidate button ''Submit order''' END AS words, count(*) AS n FROM {_S} GROUP BY ALL""",
    "kept_elements": f"SELECT CASE WHEN event_id % 2 = 0 THEN 'el_1,el_0' ELSE 'el_0,el_1' END AS kept, 1 AS omitted, count(*) AS n FROM {_S} GROUP BY 1",
    "target_hints": f"""WITH s AS (SELECT session, step, CASE WHEN event_id % 3 = 0 THEN 'el_9' ELSE target END AS target FROM {_S})
      SELECT session, step, target IS NULL OR target <> 'el_9' AS known, CASE WHEN target = 'el_9' THEN 'el_0, el_1, el_2' END AS hint, {_LABEL} AS label FROM s""",
    "risky_actions": f"SELECT CASE WHEN action = 'click' AND target = 'el_1' THEN 'Click \"Submit order\"' END AS risk, count(*) AS n FROM {_S} GROUP BY 1",
    "described": f"""WITH s AS (SELECT *, {_LABEL} AS label, {_TEXT} AS text FROM {_S})
      SELECT CASE action WHEN 'click' THEN 'Click "' || label || '"' WHEN 'type' THEN 'Type "' || text || '" into "' || label || '"' WHEN 'scroll' THEN 'Scroll down' ELSE 'Nothing to do: wait' END AS popup,
             CASE action WHEN 'click' THEN 'click ' || target || ' "' || label || '"' WHEN 'type' THEN 'type "' || text || '" into ' || target || ' "' || label || '"' WHEN 'scroll' THEN 'scroll down' ELSE 'noop: wait' END AS prompt,
             CASE action WHEN 'click' THEN 'Click “' || label || '”' WHEN 'type' THEN 'Type ' || CASE WHEN contains(text, '{{{{') THEN 'the saved ' || text ELSE '“' || text || '”' END || ' into “' || label || '”' WHEN 'scroll' THEN 'Scroll down' ELSE 'wait' END AS viewer,
             count(*) AS n FROM s GROUP BY ALL""".replace("{{{{", "{{"),
    # What a browser has parked is walked through event by event; a hello that comes later than 400 ms stays parked for ever.
    "frame_hellos": """WITH RECURSIVE e AS (
        SELECT event_id, event_id // 2 AS nonce, (event_id // 2 // 400) % 5 AS browser, CASE WHEN event_id % 22 = 1 THEN 9 ELSE 1 END AS tab,
               event_id // 2 * 5000 + CASE WHEN event_id % 2 = 1 THEN (event_id * 37) % 1900 - 950 ELSE 0 END AS ms, event_id % 2 = 1 AS hello FROM events),
      q AS (SELECT *, row_number() OVER (PARTITION BY browser ORDER BY ms, hello, event_id) AS i FROM e),
      walk AS (
        SELECT browser, 0::BIGINT AS i, []::BIGINT[] AS parked, NULL::BIGINT AS nonce, false AS hello, false AS taken FROM (SELECT DISTINCT browser FROM q)
        UNION ALL
        SELECT q.browser, q.i,
               CASE WHEN NOT q.hello THEN list_filter(w.parked, lambda n: n <> q.nonce) WHEN q.ms BETWEEN q.nonce * 5000 AND q.nonce * 5000 + 400 OR len(w.parked) >= 256 THEN w.parked ELSE list_append(w.parked, q.nonce) END,
               q.nonce, q.hello, CASE WHEN q.hello THEN q.ms BETWEEN q.nonce * 5000 AND q.nonce * 5000 + 400 ELSE list_contains(w.parked, q.nonce) END
        FROM walk w JOIN q ON q.browser = w.browser AND q.i = w.i + 1),
      met AS (SELECT nonce, bool_or(taken) AS taken FROM walk WHERE i > 0 GROUP BY nonce)
      SELECT f.event_id, coalesce(met.taken AND h.tab = f.tab, false) AS read, CASE WHEN met.taken AND h.tab = f.tab THEN h.event_id END AS hello_id
      FROM e f JOIN met ON met.nonce = f.nonce LEFT JOIN e h ON h.nonce = f.nonce AND h.hello WHERE NOT f.hello""",
    "latest_states": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "newest_captures": "SELECT event_id AS id, event_type FROM events ORDER BY event_id DESC LIMIT 30",
    # A run is accepted if it begins when the last accepted one has ended; run after run of each tab.
    "refused_runs": """WITH RECURSIVE r AS (SELECT user_id AS tab, ts, ts + INTERVAL 1 HOUR AS fin, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
      walk AS (
        SELECT tab, 0::BIGINT AS i, NULL::TIMESTAMP AS until, false AS refused FROM (SELECT DISTINCT tab FROM r)
        UNION ALL
        SELECT r.tab, r.i, CASE WHEN r.ts < w.until THEN w.until ELSE r.fin END, coalesce(r.ts < w.until, false) FROM walk w JOIN r ON r.tab = w.tab AND r.i = w.i + 1)
      SELECT tab, count(*) AS runs, count(*) FILTER (refused) AS refused FROM walk WHERE i > 0 GROUP BY tab""",
    "first_seen": """WITH f AS (SELECT user_id % 50 AS tab, user_id AS frame, min((ts, event_id)) AS first FROM events GROUP BY user_id)
      SELECT tab, frame, concat('f', row_number() OVER (PARTITION BY tab ORDER BY first)) AS id FROM f""",
    "sanitised_captures": """SELECT conv_id::VARCHAR AS "sessionId", turn::INT AS "stepIndex", concat('https://chat.example.org/c/', conv_id, '?[REDACTED]') AS url, 1 AS regions,
      CASE WHEN turn % 2 = 0 THEN 0.0 ELSE 10.0 END::DOUBLE AS x, CASE WHEN turn % 2 = 0 THEN 15.5 ELSE 20.0 END::DOUBLE AS y,
      CASE WHEN turn % 2 = 0 THEN 102.0 ELSE 80.0 END::DOUBLE AS width, CASE WHEN turn % 2 = 0 THEN 39.0 ELSE 30.0 END::DOUBLE AS height FROM conversations""",
    "capture_violations": """WITH v AS (SELECT concat_ws(',', CASE WHEN turn = 3 THEN 'stepIndex' END, CASE WHEN conv_id % 7 = 0 THEN 'protocol major' END) AS violations FROM conversations)
      SELECT violations, count(*) AS n FROM v GROUP BY 1""",
    "commands": f"SELECT event_id, s.outcome, s.target FROM events JOIN (VALUES {_OUT}) s(i, outcome, target) ON event_id % {len(SHAPES)} = s.i",
    "reply_attempts": f"""WITH r AS (SELECT event_id // 2 AS step, event_id, CASE WHEN s.i < {_USABLE} THEN s.outcome END AS action FROM events JOIN (VALUES {_OUT}) s(i, outcome, target) ON event_id % {len(SHAPES)} = s.i)
      SELECT step, arg_min(action, event_id) FILTER (action IS NOT NULL) AS action, count(action) = 0 AS failed, CASE WHEN count(action) = 0 THEN count(*) END::INT AS raws FROM r GROUP BY step""",
    "people_picked": "SELECT c_custkey AS task_id, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 1 END::INT AS person_id FROM customer",
    "placeholders": "SELECT c_custkey AS text_id, concat('Hi Ann Lee, a@b.c or {{ phone }}; no. ', c_custkey) AS resolved, 'Name,Email' AS used, 'phone' AS missing FROM customer",
    "saved_answers": """WITH a AS (SELECT c_nationkey::INT AS p, 'c_' || c_custkey % 7 AS key, 'C ' || c_custkey % 7 AS label, arg_max(c_custkey::VARCHAR, c_custkey) AS value FROM customer GROUP BY ALL),
      f AS (SELECT DISTINCT c_nationkey::INT AS p, 'c_' || c_custkey % 5 AS key FROM customer)
      SELECT coalesce(f.p, a.p) AS person_id, coalesce(f.key, a.key) AS key, coalesce(upper(f.key), a.label) AS label, coalesce(a.value, 'old') AS value, 'text' AS kind FROM f FULL JOIN a ON f.p = a.p AND f.key = a.key""",
    "group_fill": "SELECT o_custkey AS person_id, o_orderpriority AS grp, count(*) FILTER (o_orderkey % 3 <> 0) AS filled, count(*) AS total FROM orders GROUP BY ALL",
}
