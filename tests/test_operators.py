import datetime
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewarden import schema
from pagewarden.functions import pii
from pagewarden.operators import audit, captures, detections, pages, profile, sessions, store

BOX = "x double, y double, width double, height double"


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_suppression_keeps_the_confident(spark):
    rows = [(1, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 0.8, 1.0, 0.0, 10.0, 10.0), (1, 0, 2, 0.7, 20.0, 0.0, 10.0, 10.0), (1, 1, 3, 0.6, 1.0, 0.0, 10.0, 10.0), (1, 0, 4, 0.9, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, f"image_id int, cls int, idx int, conf double, {BOX}")
    assert ids(detections.suppress(df, 0.45, 10), "idx") == [(0,), (2,), (3,)]
    assert ids(detections.suppress(df, 0.45, 1), "idx") == [(0,), (3,)]
    assert ids(detections.suppress(df.where("false"), 0.45, 1), "idx") == []


def test_matching_is_one_to_one_and_ties_go_to_the_last(spark):
    d = spark.createDataFrame([(1, 0, 0, 0.5, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0)], f"image_id int, cls int, idx int, conf double, {BOX}")
    t = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 0.0, 0.0, 10.0, 10.0)], f"image_id int, cls int, id int, {BOX}")
    assert ids(detections.match(d, t), "idx", "id") == [(0, 0), (1, 1)]
    s = detections.step_scores(d, t).first()
    assert (s["dom_count"], s["found"], s["recall"], s["precision"]) == (3, 2, 0.667, 1.0)
    all_ = {r["threshold"]: r for r in detections.sweep(d, t).where("cls IS NULL").collect()}
    assert (all_[0.25]["found"], all_[0.6]["found"], all_[0.6]["detections"]) == (2, 1, 1)


def test_candidates(spark):
    vp = (1280.0, 720.0)
    rows = [
        (0, 100.0, 100.0, 90.0, 36.0, 0.9, "el_0"), (1, 300.0, 300.0, 90.0, 36.0, 0.8, None), (2, 300.0, 300.0, 90.0, 36.0, 0.4, None), (3, 600.0, 300.0, 90.0, 36.0, 0.7, None),
        (4, 0.0, 0.0, 1000.0, 700.0, 0.9, None), (5, 10.0, 10.0, 6.0, 6.0, 0.9, None), (6, 2000.0, 10.0, 20.0, 20.0, 0.9, None), (7, 810.0, 310.0, 20.0, 20.0, 0.9, None),
    ]
    v = spark.createDataFrame([(1, i, "button", x, y, w, h, c, m, *vp) for i, x, y, w, h, c, m in rows], f"image_id int, idx int, role string, {BOX}, conf double, matched_id string, vw double, vh double")
    e = spark.createDataFrame([(1, 800.0, 300.0, 40.0, 40.0, True, True), (1, 300.0, 300.0, 90.0, 36.0, True, False)], f"image_id int, {BOX}, is_visible boolean, is_interactive boolean")
    assert ids(detections.vision_only(v, e), "idx", "px", "py") == [(1, 345.0, 318.0), (3, 645.0, 318.0)]
    assert ids(detections.vision_only(v, e, most=1), "idx") == [(1,)]


def test_faces_and_anchors(spark):
    a = spark.createDataFrame([(1, 0, 0.9, 0.1, 0.1, 0.3, 0.3, 100.0, 100.0), (1, 1, 0.8, 0.11, 0.1, 0.31, 0.3, 100.0, 100.0), (1, 2, 0.2, 0.5, 0.5, 0.9, 0.9, 100.0, 100.0)], "image_id int, anchor int, score double, x1 double, y1 double, x2 double, y2 double, img_w double, img_h double")
    got = detections.decode_faces(a, 0.5).collect()
    assert [(r["x"], r["width"], r["conf"], r["category"], r["method"]) for r in got] == [(10.0, 20.0, 0.9, "face", "ml")]
    b = spark.createDataFrame([(1, 0, 320.0, 320.0, 100.0, 40.0, [0.1, 0.8, 0.2], 1280.0, 720.0), (1, 1, 320.0, 320.0, 2.0, 2.0, [0.9, 0.1, 0.1], 1280.0, 720.0)], "image_id int, anchor int, cx double, cy double, w double, h double, scores array<double>, img_w double, img_h double")
    got = detections.decode_anchors(b, 0.25, 640).orderBy("idx").collect()
    assert [(r["cls"], r["x"], r["y"], r["width"], r["height"]) for r in got] == [(1, 540.0, 320.0, 200.0, 80.0), (0, 638.0, 358.0, 4.0, 4.0)]


def test_percentiles_and_empty_groups(spark):
    df = spark.createDataFrame([("a", float(i)) for i in (1, 2, 3, 4)] + [("b", None)], "g string, v double")
    assert ids(detections.percentile(df, ["g"], "v", (50, 95)), "g", "p50", "p95") == [("a", 3.0, 4.0)]
    assert ids(detections.upper_median(df, ["g"], "v"), "g", "median") == [("a", 3.0)]
    one = df.where("g = 'a'").groupBy("g").agg(F.collect_list("v").alias("v")).select(detections.nearest_rank(F.col("v"), 50).alias("p")).first()
    assert one["p"] == 3.0


def test_uncovered_regions(spark):
    r = spark.createDataFrame([(1, 0, 10.0, 10.0, 10.0, 10.0), (1, 1, 50.0, 50.0, 10.0, 10.0)], f"image_id int, id int, {BOX}")
    m = spark.createDataFrame([(1, 9.0, 9.0, 12.0, 12.0)], f"image_id int, {BOX}")
    assert ids(detections.uncovered(r, m, 0.1), "id") == [(1,)] and ids(detections.uncovered(r, m, 0.2), "id") == [(0,), (1,)]


HTML = """<!doctype html><title>T</title><nav><a href="/x">Go <b>there</b></a><a>no link</a></nav><h1>Top</h1><script>var a="4111 1111 1111 1111"</script>
<label for="m">Your mail</label><input id="m" type="email" value="jane@x.io" placeholder="p"><input type=checkbox name=c checked><input type="submit" value="Send"><input type=hidden name=h>
<p>Call +1 415 555 0132 now<p>short<textarea name=t>x</textarea><div role="status"></div><div role="status">Saved!</div><span id="l1">First</span> <span id="l2">Last</span>
<div role="textbox" aria-labelledby="l1 l2"></div><img alt="Cat" src="x"><button disabled aria-label=" Close "> X</button><select name="s"></select>"""


def test_page_elements(spark):
    nodes = pages.parse_pages(spark.createDataFrame([(1, HTML), (2, None), (3, "<b>unclosed <a href='q'>x")], "page_id long, html string"))
    got = [(r["id"], r["role"], r["label"], r["attributes"], r["is_interactive"]) for r in pages.element_table(nodes).where("page_id = 1").orderBy("pos").collect()]
    want = [
        ("link", "Go there", {"href": "/x"}, True), ("heading", "Top", None, False), ("textbox", "Your mail", {"type": "email", "placeholder": "p", "filled": "yes"}, True),
        ("checkbox", "c", {"type": "checkbox", "name": "c", "checked": "yes"}, True), ("button", "Send", {"type": "submit"}, True), ("textbox", "h", {"type": "hidden", "name": "h"}, True),
        ("textbox", "t", {"name": "t"}, True), ("text", "Saved!", None, False), ("textbox", "First Last", None, True), ("image", "Cat", {"alt": "Cat"}, False), ("button", "Close", {"aria-label": " Close "}, False), ("select", "s", {"name": "s"}, True),
    ]
    assert got == [(f"el_{i}", *w) for i, w in enumerate(want)]
    assert ids(pages.element_table(nodes).where("page_id = 3"), "role", "label") == [("link", "x")]
    assert [(r["kind"]) for r in pages.page_pii(nodes).collect()] == ["phone"]
    controls = nodes.where("page_id = 1 AND kind = 'element'").select(pages.control_class(F.col("tag"), F.col("attributes")).alias("c")).where("c IS NOT NULL").groupBy("c").count()
    assert dict(ids(controls, "c", "count")) == {"button": 2, "input": 5, "link": 1}


def test_fields_values(spark):
    rows = [("jane@x.io", "text", False, "email"), ("abc", "tel", False, "phone"), ("abc", "email", False, "email"), ("abc", "text", True, "pii_text"), ("abc", "text", False, None), ("", "tel", False, None), ("f.pdf", "file", True, "pii_text"), ("f.pdf", "file", False, None), ("x", "password", True, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, t string, p boolean, want string")
    assert df.where(~pii.value_category(F.col("v"), F.col("t"), F.col("p")).eqNullSafe(F.col("want"))).collect() == []


def element(i, role="button", label="Go", a=None, visible=True, active=True):
    return (f"el_{i}", role, label, (0.0, 0.0, 10.0, 10.0), a, visible, active, None)


def command(action, target=None, text=None, **more):
    order = ("action", "target", "text", "submit", "direction", "amountPx", "url", "ms", "summary", "question", "reason", "reasoning", "confidence")
    return tuple({"action": action, "target": target, "text": text, **more}.get(k) for k in order)


def test_gate(spark):
    els = [element(0, "textbox", "Search", {"filled": "yes"}), element(1, "button", "Pay now"), element(2, "textbox", "Note")]
    steps = [command("click", "el_2"), command("click", "el_2"), command("click", "el_1"), command("type", "el_2", " "), command("type", "el_0", "Cheap Flights"), command("type", "el_0", "mallory"), command("type", "el_2", "{{email}}"), command("type", "el_0", "flights", submit=True)]
    rows = [("s", i, "find cheap flights", c, els, ["email"] if c[2] == "{{email}}" else []) for i, c in enumerate(steps)]
    df = spark.createDataFrame(rows, f"session string, step int, task string, command {sessions.COMMAND}, elements array<{schema.ELEMENT}>, missing array<string>")
    got = [r["verdict"] for r in sessions.gate(df).orderBy("step").collect()]
    assert got == ["run", "skip_repeat", "confirm", "skip_field", "run", "needs_user", "needs_user", "confirm"]
    assert [r["verdict"] for r in sessions.gate(df, auto_confirm=True).orderBy("step").collect()][2] == "run"


def test_element_choice_and_decisions(spark):
    els = [element(0, "text", "Hi", visible=False), element(1, "button", "One"), element(2, "button", "Submit it"), element(3, "link", "L", active=False)]
    df = spark.createDataFrame([(els, 0), (els, 5), ([], 0)], f"elements array<{schema.ELEMENT}>, step int")
    kept = [([e["id"] for e in r["elements"]], r["omitted"]) for r in sessions.select_elements(df, 3).collect()]
    assert kept[0] == (["el_0", "el_1", "el_2"], 1) and kept[2] == ([], 0)
    assert sessions.select_elements(df, 0).first()["omitted"] == 0
    assert [(r["d"]["action"], r["d"]["target"]) for r in df.select(sessions.mock_decision(F.col("elements"), F.col("step")).alias("d")).collect()] == [("click", "el_2"), ("done", None), ("noop", None)]
    assert [r[0] for r in df.select(sessions.describe_ids(F.col("elements"))).collect()] == ["el_0, el_1, el_2, el_3"] * 2 + ["none (the page has no listed elements)"]


def test_outcomes_and_forms(spark):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    log = spark.createDataFrame([("a", 0, "running", "el_1", at(0), at(1)), ("a", 1, "done", "vis_2", at(2), at(5))], "session string, step int, status string, target string, started_at timestamp, finished_at timestamp")
    assert ids(sessions.outcomes(log), "steps", "status", "seconds", "vision_steps", "listed_steps") == [(2, "done", 5.0, 1, 1)]
    c = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 7)], "s string, id int, n int")
    assert ids(sessions.most_vision_only(c, "s", "n"), "s", "id", "n") == [("a", 2, 7)]
    e, g = (spark.createDataFrame(r, "form string, key string, value string") for r in ([("f", "a", "1"), ("f", "b", "2"), ("f", "c", "3")], [("f", "a", "1"), ("f", "b", "x")]))
    assert [(r["filled"], r["wrong"]) for r in sessions.field_fill(e, g).collect()] == [("1/3", ["b", "c"])]


def capture(**more):
    base = {
        "protocolVersion": "0.1.0", "sessionId": "s", "stepIndex": 0, "task": " Book it ", "page": ("https://e.com/", "Shop", "2026-01-01T00:00:00Z"), "viewport": (1280.0, 720.0, 0.0, 0.0, 1.0),
        "elements": [element(0, "textbox", "Email", {"type": "email"}), element(1, "button", "Buy"), element(2, "text", "Saved. ", None, True, False)], "screenshot": None,
        "redactions": [((0.0, 0.0, 1.0, 1.0), "email", 1.0, "dom"), ((0.0, 0.0, 1.0, 1.0), "email", 1.0, "dom")], "history": [command("click", "el_1"), command("type", "el_0", "{{email}}")],
        "perception": ("m", 1.0, None, None, None, None, None, None, None), "pageText": "Hello", "profileFields": [("email", "Email")],
    }
    return tuple({**base, **more}.values())


def test_prompts(spark):
    df = spark.createDataFrame([capture()], schema.CAPTURE)
    prompt = captures.action_prompt(df, 60).first()["prompt"].split("\n")
    assert prompt[:6] == ["Task: Book it", "", 'Page: "Shop" (https://e.com/)', "Viewport: 1280x720 CSS px. Locations are approximate: a 3x3 grid word, then x, y, width, height.", "Step: 0", "Previous actions (all already done successfully):"]
    for line in ('  1. click el_1 "Buy"', '  2. type "{{email}}" into el_0 "Email"', "Page messages:", '  "Saved."', "  {{email}} = Email", "Already typed: {{email}}. Do not type these again.", '  el_0 "Email"', "Redacted regions: 2 area(s) hidden for privacy; their contents are unavailable.", "Screenshot: not provided; rely on the element list."):
        assert line in prompt, line
    assert 'el_0 | textbox | "Email" | top-left (x=0, y=0, w=10, h=10) [type=email]' in prompt and 'el_2 | text | "Saved." | top-left (x=0, y=0, w=10, h=10) [not interactive]' in prompt
    assert any(x.startswith('Already clicked: "Buy". Do not click') for x in prompt)
    ask = captures.question_prompt(df).first()["prompt"]
    assert "Hidden on the user's device before sending: 2 email addresss." in ask and "  - textbox (email): Email" in ask and '"""\nHello\n"""' in ask
    assert "(1 more elements omitted)" in captures.action_prompt(df, 2).first()["prompt"]


@pytest.mark.parametrize("change,broken", [({}, []), ({"stepIndex": -1}, ["stepIndex"]), ({"protocolVersion": "1.0.0"}, ["protocol major"]), ({"redactions": [((0.0, 0.0, 1.0, 1.0), "nose", 1.0, "dom")]}, ["redactions"]), ({"history": [command("click")]}, ["history"]), ({"viewport": (1.0, 1.0, 0.0, 0.0, 0.0)}, ["viewport"]), ({"pageText": "x" * 20_001}, ["pageText"])])
def test_contract(spark, change, broken):
    valid, rejects = captures.split_valid(spark.createDataFrame([capture(**change)], schema.CAPTURE))
    assert valid.count() == (not broken) and [r["violations"] for r in rejects.collect()] == ([broken] if broken else [])


def test_unknown_keys(spark):
    cases = [
        ({"task": "x", "extra": 1}, ["extra"]),
        ({"page": {"evil": 1, "url": "u"}}, ["page.evil"]),
        ({"elements": [{"id": "a", "bbox": {"x": 1, "z": {}}}, {"bad": None, "attributes": {"any": "x"}}, 3]}, ["elements[].bad", "elements[].bbox.z"]),
        ({"history": [{"action": "click", "why": []}], "viewport": {"scrollX": 1, "zoom": 2}}, ["history[].why", "viewport.zoom"]),
        ({"perception": {"visualElements": [{"bbox": {"q": 1}, "role": "r"}], "model": 1}}, ["perception.model", "perception.visualElements[].bbox.q"]),
        ({"page.url": 1, "page": "not an object", "redactions": {"a": 1}}, ["page.url"]),
        ({}, []), ([1], []), ("text", []),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(90, "no {json"), (91, None)], "i int, j string")
    got = {r["i"]: r["u"] for r in df.select("i", captures.unknown_keys(F.col("j")).alias("u")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)} | {90: [], 91: []}


def test_unknown_keys_are_violations(spark):
    good = capture()
    rows = spark.createDataFrame([good], schema.CAPTURE).withColumn("raw", F.explode(F.array(F.lit('{"task": "x"}'), F.lit('{"page": {"evil": 1}}'))))
    valid, rejects = captures.split_valid(rows, "raw")
    assert [r["raw"] for r in valid.collect()] == ['{"task": "x"}']
    assert [r["violations"] for r in rejects.collect()] == [["unknown: page.evil"]]


def test_frames(spark):
    p = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 10.0, 10.0, True), (1, 1, "b", 0.0, 200.0, 10.0, 10.0, True)], f"page_id int, pos int, id string, {BOX}, is_visible boolean")
    f = spark.createDataFrame([(1, 1, "n1", 0.0, 50.0, 100.0, 100.0, 0.0, 50.0), (1, 2, "n2", 0.0, 300.0, 50.0, 50.0, 0.0, 300.0)], f"page_id int, frame_no int, nonce string, {BOX}, origin_x double, origin_y double")
    i = spark.createDataFrame([("n1", 0, "el_f1_0", 1.0, 1.0, 5.0, 5.0, True), ("n1", 1, "el_f1_1", 500.0, 1.0, 5.0, 5.0, True)], f"nonce string, pos int, id string, {BOX}, is_visible boolean")
    merged, unread = captures.merge_frames(p, f, i)
    assert [(r["id"], r["y"], r["is_visible"]) for r in merged.orderBy("position").collect()] == [("a", 0.0, True), ("el_f1_0", 51.0, True), ("el_f1_1", 51.0, False), ("b", 200.0, True)]
    assert ids(unread, "frame_no") == [(2,)]
    n = spark.createDataFrame([("n1", 90.0, 0.0, 50.0, 20.0), ("n1", 200.0, 0.0, 5.0, 5.0)], f"nonce string, {BOX}")
    assert ids(captures.nested_frames(f, n), "x", "y", "width", "height") == [(90.0, 50.0, 10.0, 20.0)]
    lines = spark.createDataFrame([(1, 1, "Mail jane@x.io", 0.91234), (1, 1, " ", 0.9), (1, 1, "faint", 0.4)], "page_id int, frame_no int, text string, confidence double")
    kept = captures.readable_lines(lines)
    assert ids(captures.line_regions(kept), "category", "confidence", "method") == [("email", 0.912, "ocr")]
    assert ids(captures.whole_frame_regions(f, kept), "category", "method") == [("other", "ocr")]
    view = f.withColumn("vw", F.lit(100.0)).withColumn("vh", F.lit(310.0))
    assert ids(captures.frames_in_view(view), "frame_no", "height") == [(1, 100.0)]
    assert [r[0] for r in spark.createDataFrame([("el_f2_7",), ("el_7",)], "i string").select(captures.frame_number_of(F.col("i"))).collect()] == [2, 0]


def test_regions_of_fields_and_photos(spark):
    e = spark.createDataFrame([(1, "textbox", "PIN", {"a": "b"}, True, 0.0, 0.0, 9.0, 9.0), (1, "textbox", "PIN", None, False, 0.0, 0.0, 9.0, 9.0)], f"image_id int, role string, label string, attributes map<string,string>, is_visible boolean, {BOX}")
    assert ids(captures.dom_regions(e), "category", "confidence", "method") == [("credential", 1.0, "dom")]
    rows = [("img", {"a": ""}, None, False, 30.0), ("img", {"a": ""}, None, False, 10.0), ("picture", {"a": ""}, None, True, 30.0), ("div", {"a": ""}, "url(x)", False, 30.0), ("div", {"role": "img"}, None, False, 30.0), ("svg", {"a": ""}, None, False, 30.0)]
    p = spark.createDataFrame([(1, t, a, b, w, 0.0, 0.0, s, s) for t, a, b, w, s in rows], f"page_id int, tag string, attributes map<string,string>, background string, wraps_img boolean, {BOX}")
    assert pages.photo_regions(p).count() == 3
    pts = spark.createDataFrame([(1, 0, "n1", False, False, False, False, True), (1, 1, "n1", False, False, False, False, True), (1, 2, None, False, False, False, False, True), (1, 3, "c", False, False, False, True, False), (1, 4, "c", False, False, False, True, False), (1, 5, "d", True, False, False, False, True)], "image_id int, idx int, node string, disabled boolean, listed_node boolean, sensitive boolean, is_surface boolean, clickable boolean")
    assert [r["reason"] for r in pages.adjudicate_points(pts).orderBy("idx").collect()] == [None, "claimed", "nothing", None, None, "disabled"]


def test_people_and_details(spark):
    people = spark.createDataFrame([(1, "Me", True, 0), (2, "Father", False, 1), (3, "Al", False, 2)], "person_id int, name string, active boolean, pos int")
    tasks = spark.createDataFrame([(1, "use my saved details"), (2, "my father's details"), (3, "also do it"), (4, "AL, please")], "task_id int, task string")
    assert ids(profile.pick_person(tasks, people), "task_id", "person_id") == [(1, 1), (2, 2), (3, 1), (4, 3)]
    fields = spark.createDataFrame([(1, "email", "Email", "a@b.c", "text", 0), (1, "resume", "Resume", "r.pdf", "file", 1), (1, "x", "X", " ", "text", 2)], "person_id int, key string, label string, value string, kind string, pos int")
    assert ids(profile.field_names(fields), "key", "label") == [("email", "Email"), ("resume", "Resume (file to upload)")]
    texts = spark.createDataFrame([(1, "to {{ Email }}, {nope} and {x}."), (2, "plain"), (3, "{{resume}}")], "text_id int, text string")
    got = {r["text_id"]: r for r in profile.resolve(texts, fields).collect()}
    assert (got[1]["resolved"], got[1]["used"], got[1]["missing"]) == ("to a@b.c, {nope} and {x}.", ["Email"], ["nope", "x"])
    assert (got[2]["resolved"], got[2]["used"], got[3]["file"], got[1]["file"]) == ("plain", [], "Resume", None)
    new = spark.createDataFrame([(1, "Card PIN"), (1, "Email"), (1, "Pet name"), (1, "PIN code")], "person_id int, label string")
    assert ids(profile.may_add(new, fields), "key") == [("pet_name",), ("pin_code",)]
    saved = profile.save_answers(fields.drop("pos"), spark.createDataFrame([(1, "Email *", "new", 1), (1, "Email", "newer", 2), (1, "City (optional)", "Pune", 3)], "person_id int, label string, value string, seq int"))
    assert ids(saved, "key", "label", "value") == [("city", "City", "Pune"), ("email", "Email", "newer"), ("resume", "Resume", "r.pdf"), ("x", "X", " ")]
    d = spark.createDataFrame([("email", "Email", 0), ("phone", "Phone", 1)], "key string, label string, pos int")
    assert [(r["key"], r["value"]) for r in profile.with_defaults(d, fields).orderBy("position").collect()] == [("email", "a@b.c"), ("phone", ""), ("resume", "r.pdf"), ("x", " ")]


def test_audit(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "say open the big door now"), (2, "hush"), (3, None)], "doc_id int, text string")
    secrets = spark.createDataFrame([("a", "en the big do"), ("b", "hush"), ("c", ""), ("d", "absent words here"), ("b", "hush")], "label string, value string")
    want = [(1, "a"), (2, "b")]
    assert ids(audit.leaks(texts, secrets), "doc_id", "label") == want
    monkeypatch.setattr(audit, "BLOCK_CHARS", 10)
    assert ids(audit.leaks(texts, secrets), "doc_id", "label") == want
    assert audit.rescan(spark.createDataFrame([("x [REDACTED]",), ("jane@x.io is left",)], "text string")).count() == 1


@pytest.mark.parametrize("block_chars", [1 << 20, 40])
def test_leaks_by_brute_force(spark, monkeypatch, block_chars):
    monkeypatch.setattr(audit, "BLOCK_CHARS", block_chars)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abc é\n\"") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 60)), "x") for i in range(200)] + [(900, None, "x"), (901, "", "x"), (902, "ab" * 200_000 + "needle", "x")]
    secrets = [(f"s{i}", word(rng.randrange(1, 5))) for i in range(60)] + [("n", "needle"), ("m", "eedl"), ("same", "needle"), ("none", None), ("empty", ""), ("two", "ab"), ("two", "ba")]
    want = sorted((i, label) for i, t, _ in texts for label, v in set(secrets) if v and t and v in t)
    got = audit.leaks(spark.createDataFrame(texts, "doc_id int, text string, `other.column` string").repartition(5), spark.createDataFrame(secrets, "label string, value string"))
    assert got.columns == ["doc_id", "other.column", "label"] and sorted((r["doc_id"], r["label"]) for r in got.collect()) == want


def test_many_secrets_move_no_text(spark):
    secrets = spark.range(100_000).selectExpr("CAST(id AS STRING) AS label", "concat('secret number ', id, ' ends') AS value")
    texts = spark.range(2000).selectExpr("id AS doc_id", "repeat(concat('filler text ', id, '. '), 20) AS filler").selectExpr("doc_id", "concat(filler, 'secret number ', doc_id * 7, ' ends', filler) AS text")
    found = audit.leaks(texts, secrets)
    assert {(r["doc_id"], r["label"]) for r in found.collect()} == {(i, str(i * 7)) for i in range(2000)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.split("\n") if "Exchange" in line]
    assert exchanged and not any("_text" in line or "filler" in line for line in exchanged)


def walk(v, path="$"):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walk(x, f"{path}.{k.replace('~', '~0').replace('.', '~1').replace('[', '~2')}")
        if not v:
            yield path, None
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]")
        if not v:
            yield path, None
    else:
        yield path, v if isinstance(v, str) or v is None else json.dumps(v)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_json_leaves(spark, levels):
    deep = {"a": 1}
    for i in range(9):
        deep = {"k": [deep, i]} if i % 2 else {"k.x": deep, "~[": "s"}
    payloads = [{"a": "x\ny \"q\" é", "b": [1, [True, None, "z"], {}], "c": {"d": {"e": 2.5}}, "f": []}, [], {}, "text", 3, None, deep, [[["deep"]]]]
    rows = [(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(100, "no {json"), (101, None), (102, "")]
    got = Counter(tuple(r) for r in audit.json_leaves(spark.createDataFrame(rows, "i int, payload string"), "payload", levels).collect())
    want = Counter((i, *x) for i, p in enumerate(payloads) for x in walk(p)) + Counter([(100, "$", "no {json"), (102, "$", "")])
    assert got == want


def test_leaks_in_escaped_leaves(spark):
    payloads = [(1, json.dumps({"page": {"title": 'say "hi"\nthere'}, "n": [1, {"x": "é secret"}]})), (2, "plain é secret text"), (3, json.dumps({"é secret": "key"}))]
    secrets = spark.createDataFrame([("a", '"hi"\nthere'), ("b", "é secret")], "label string, value string")
    got = audit.payload_leaks(spark.createDataFrame(payloads, "i int, payload string"), secrets)
    assert sorted(map(tuple, got.collect())) == [(1, "$.n[1].x", "b"), (1, "$.page.title", "a"), (2, "$", "b")]


def random_boxes(n, extent, size, seed, images=3, classes=2):
    rng = random.Random(seed)
    return [(rng.randrange(images), rng.randrange(classes), i, rng.choice([0.5, 0.6, rng.random()]), float(rng.randrange(-20, extent)), float(rng.randrange(-20, extent)), float(rng.randrange(0, size)), float(rng.randrange(0, size))) for i in range(n)]


def overlap(a, b):
    w, h = min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]), min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5])
    return w * h / (a[6] * a[7] + b[6] * b[7] - w * h) if w > 0 and h > 0 else 0.0


DETS = f"image_id int, cls int, idx int, conf double, {BOX}"


@pytest.mark.parametrize("side", [16.0, 128.0])
def test_grid_joins_by_brute_force(spark, side):
    a, b = random_boxes(300, 700, 90, 1), random_boxes(200, 700, 400, 2) + [(0, 0, 900, 0.9, 128.0, 128.0, 128.0, 128.0), (0, 0, 901, 0.9, 0.0, 0.0, 5000.0, 10.0), (1, 0, 902, 0.5, 256.0, 256.0, 0.0, 0.0)]
    da, db = spark.createDataFrame(a, DETS), spark.createDataFrame(b, DETS)
    best = {(r["image_id"], r["id"]): round(r["iou"], 9) for r in detections.best_iou(da.withColumnRenamed("idx", "id"), db, side).collect()}
    assert best == {(x[0], x[2]): round(max((overlap(x, y) for y in b if y[0] == x[0]), default=0.0), 9) for x in a}
    for margin in (0.0, 0.1):
        inside = lambda x, y: x[0] == y[0] and y[4] <= x[4] - margin * x[6] and y[5] <= x[5] - margin * x[7] and y[4] + y[6] >= x[4] + x[6] + margin * x[6] and y[5] + y[7] >= x[5] + x[7] + margin * x[7]
        assert ids(detections.uncovered(da, db, margin, side), "idx") == sorted((x[2],) for x in a if not any(inside(x, y) for y in b))
    visual = da.withColumn("role", F.lit("button")).withColumn("matched_id", F.lit(None).cast("string")).withColumn("vw", F.lit(700.0)).withColumn("vh", F.lit(700.0))
    listed = db.withColumn("is_visible", F.lit(True)).withColumn("is_interactive", F.col("idx") % 2 == 0)
    got = ids(detections.vision_only(visual, listed, 0.3, 1000, side=side), "idx")
    centre = lambda x: (x[4] + x[6] / 2, x[5] + x[7] / 2)
    within = lambda p, y: y[4] <= p[0] <= y[4] + y[6] and y[5] <= p[1] <= y[5] + y[7]
    want = [x for x in a if x[3] >= 0.3 and x[6] >= 8 and x[7] >= 8 and x[6] * x[7] <= 0.25 * 700 * 700 and 0 <= centre(x)[0] < 700 and 0 <= centre(x)[1] < 700 and not any(y[0] == x[0] and y[2] % 2 == 0 and within(centre(x), y) for y in b)]
    assert got == sorted((x[2],) for x in want)
    assert detections.cell_side(db) == 512.0 and detections.cell_side(db.where("false")) == 128.0


def test_dense_suppression_is_suppression(spark):
    df = spark.createDataFrame(random_boxes(600, 300, 60, 5), DETS)
    for most in (1000, 7):
        want = ids(detections.suppress(df, 0.3, most), "image_id", "cls", "idx")
        assert ids(detections.suppress_dense(df, 0.3, most, dense=50, side=32.0), "image_id", "cls", "idx") == want
        assert ids(detections.suppress_dense(df, 0.3, most), "image_id", "cls", "idx") == want
    assert detections.suppress_dense(df.where("false"), 0.3, 10).collect() == []


def test_an_image_of_100000_boxes(spark):
    n, rng = 100_000, random.Random(3)
    rows = [(1, 0, i, rng.random(), float(x := rng.randrange(6000)), float(y := rng.randrange(6000)), 20.0, 20.0) for i in range(n)]
    df = spark.createDataFrame(rows, DETS)
    grid = {}
    for r in rows:
        grid.setdefault((int(r[4] // 20), int(r[5] // 20)), []).append(r)
    near = lambda r: (q for i in (-1, 0, 1) for j in (-1, 0, 1) for q in grid.get((int(r[4] // 20) + i, int(r[5] // 20) + j), ()))
    kept, taken = [], set()
    for r in sorted(rows, key=lambda r: (-r[3], r[2])):
        if not any(q[2] in taken and overlap(r, q) > 0.3 for q in near(r)):
            taken.add(r[2])
            kept.append(r[2])
    assert ids(detections.suppress_dense(df, 0.3, n, side=32.0), "idx") == sorted((i,) for i in kept)
    half = df.where("idx % 2 = 0")
    best = {r["id"]: round(r["iou"], 9) for r in detections.best_iou(half.withColumnRenamed("idx", "id"), df.where("idx % 2 = 1"), 32.0).collect()}
    assert best == {r[2]: round(max((overlap(r, q) for q in near(r) if q[2] % 2), default=0.0), 9) for r in rows if r[2] % 2 == 0}
    assert detections.uncovered(half, df.where("idx % 2 = 1")).count() > 45_000


def test_basket(spark):
    rows = [(1, i, "book", p) for i, p in enumerate((500.0, 400.0, 300.0, 200.0))] + [(1, 9, "laptop", 59000.0), (2, 0, "book", 100.0)]
    got = {r["basket"]: tuple(r)[1:] for r in store.totals(spark.createDataFrame(rows, "basket int, item int, kind string, price double")).collect()}
    assert got == {1: (60400.0, 2201.0, 0, 58199.0), 2: (100.0, 0.0, 49, 149.0)}


def test_refused_runs(spark):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    r = spark.createDataFrame([(1, at(0), at(10)), (1, at(5), at(6)), (1, at(20), at(30))], "tab int, started_at timestamp, finished_at timestamp")
    assert [x["refused"] for x in sessions.overlapping_steps(r).orderBy("started_at").collect()] == [False, True, False]


def test_small_rules(spark):
    rows = [("button", "", False, True, True), ("link", "", False, True, False), ("text", " ", True, True, False), ("text", "Hi", True, True, True), ("textbox", "", False, False, False)]
    df = spark.createDataFrame(rows, "role string, text string, visible boolean, rendered boolean, want boolean")
    assert df.where(pages.keep_element(F.col("role"), F.col("text"), F.col("visible"), F.col("rendered")) != F.col("want")).collect() == []
    reads = spark.createDataFrame([("s", 3, 10), ("s", None, None)], "step string, lines int, ms int")
    assert ids(captures.ocr_totals(reads, "step"), "lines", "ms") == [(3, 10)]
    sizes = spark.createDataFrame([(638.0, 1241.0), (5.0, None)], "a double, b double")
    assert [r[0] for r in sizes.select(detections.size_share(F.col("a"), F.col("b"))).collect()] == [51, 100]
