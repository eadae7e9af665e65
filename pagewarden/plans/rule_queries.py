"""Queries over single rules: fields, frames, points, details, sources; each with its DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden import schema, sources, streaming
from pagewarden.functions import boxes as B
from pagewarden.functions import pii
from pagewarden.functions import text as T
from pagewarden.functions import values as V
from pagewarden.operators import captures as C
from pagewarden.operators import pages as P
from pagewarden.operators import profile
from pagewarden.operators import sessions as S
from pagewarden.plans import views
from pagewarden.plans.session_queries import _captures
from pagewarden.plans.text_queries import _pii, _spans
from pagewarden.plans.views import DETS, duck, table

ROLES = ("textbox", "button", "text")
LABELS = ("Your password", "Card number", "Full name", "One-time code")
TAGS = ("img", "div", "video", "picture", "svg")


def _dets(spark: SparkSession, sf: str) -> DataFrame:
    return views.run(spark, sf, DETS)


def _pick(words, number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in words)), (number % len(words) + 1).cast("int"))


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for what a query writes and reads back: in the session's shared one, or a local session's temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="spark-")
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/pagewarden/{uuid.uuid4().hex}-{name}"


def hidden_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pii.hide_lines(F.col("text")).alias("shown"))


def typed_values(spark, sf):
    k = F.col("c_custkey")
    kind = F.when(k % 7 < 6, _pick(("text", "email", "tel", "password", "file", "checkbox"), k % 7))
    value = F.when(k % 3 == 0, F.concat(F.lit("me"), k.cast("string"), F.lit("@shop.example"))).when(k % 3 == 1, "").otherwise("just words")
    return table(spark, sf, "customer").select("c_custkey", pii.value_category(value, kind, k % 5 == 0).alias("category"))


def hidden_text(spark, sf):
    return _spans(spark, sf).select("doc_id", pii.hidden_text_items((F.col("doc_id") % 4).cast("int"), F.size("spans")).alias("hidden"))


def field_regions(spark, sf):
    e = _dets(spark, sf).withColumn("role", _pick(ROLES, F.col("cls"))).withColumn("label", _pick(LABELS, F.col("idx") % 4)).withColumn("is_visible", F.col("idx") % 3 != 0)
    r = C.dom_regions(e.withColumn("attributes", F.create_map(F.lit("type"), F.when(F.col("x") == 0, "password").otherwise("text"))))
    return C.all_regions(r, r.where("x > 100")).groupBy("image_id", "category").agg(F.count("*").alias("n"), F.sum("width").alias("width"))


def kept_nodes(spark, sf):
    d, b = _dets(spark, sf), B.box("x", "y", "width", "height")
    text = F.when(F.col("idx") % 2 == 0, " ").otherwise("Ready")
    keep = P.keep_element(_pick(ROLES, F.col("cls")), text, B.element_visible(b, F.lit(200.0), F.lit(100.0)), B.rendered(b))
    return d.groupBy("image_id").agg(F.count_if(keep).alias("kept"), F.count_if(B.comparable(b, F.lit(200.0), F.lit(100.0))).alias("comparable"))


def photo_regions(spark, sf):
    d = _dets(spark, sf).withColumnRenamed("image_id", "page_id").withColumn("height", F.col("height") - 25)
    a = F.when(F.col("idx") % 4 == 1, F.create_map(F.lit("role"), F.lit("img"))).otherwise(F.create_map().cast("map<string,string>"))
    e = d.withColumn("tag", _pick(TAGS, F.col("x") / 40)).withColumn("attributes", a).withColumn("background", F.when(F.col("y") == 0, "url(a.png)")).withColumn("wraps_img", F.col("idx") % 2 == 0)
    return P.photo_regions(e).groupBy("page_id").agg(F.count("*").alias("photos"), F.sum("width").alias("width"))


def judged_points(spark, sf):
    d, i = _dets(spark, sf), F.col("idx")
    p = d.select(
        "image_id", "idx", F.when(F.col("x") > 0, F.col("cls")).alias("node"), (F.col("y") == 30).alias("disabled"), (F.col("y") == 60).alias("listed_node"), (F.col("x") == 80).alias("sensitive"),
        (i % 3 == 0).alias("is_surface"), (i % 2 == 0).alias("clickable"),
    )
    return P.adjudicate_points(p).select("image_id", "idx", "reason")


def saved_names(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    fields = c.select(k.alias("person_id"), F.when(k % 5 == 0, "").otherwise("doc").alias("key"), F.lit("Document").alias("label"), F.when(k % 3 == 0, " ").otherwise("x").alias("value"), F.when(k % 2 == 0, "file").otherwise("text").alias("kind"))
    return profile.field_names(fields)


def allowed_details(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    label = _pick(("Shoe size", "Card PIN", "PIN code", "E-mail password", "Shirt size"), k % 5)
    return profile.may_add(c.select(k.alias("person_id"), label.alias("label")), c.where("c_custkey % 2 = 0").select(k.alias("person_id"), F.lit("shirt_size").alias("key"))).select("person_id", "key", "label")


def readable_lines(spark, sf):
    lines = _dets(spark, sf).select("image_id", "idx", F.when(F.col("idx") % 4 == 0, "\t ").otherwise("Total").alias("text"), F.col("conf").alias("confidence"))
    return C.readable_lines(lines)


def _frames(spark, sf):
    return _dets(spark, sf).select(F.col("image_id").alias("page_id"), F.col("idx").alias("frame_no"), (F.col("x") - 50).alias("x"), (F.col("y") - 30).alias("y"), "width", "height", F.lit(220.0).alias("vw"), F.lit(90.0).alias("vh"))


def unread_frames(spark, sf):
    f = _frames(spark, sf)
    return C.whole_frame_regions(f, f.where("frame_no % 3 <> 0").select("page_id", "frame_no"))


def viewed_frames(spark, sf):
    return C.frames_in_view(_frames(spark, sf))


def nested_frames(spark, sf):
    f = _frames(spark, sf).withColumn("nonce", F.concat_ws("-", "page_id", "frame_no")).withColumn("origin_x", F.col("x") + 2).withColumn("origin_y", F.col("y") + 2)
    inner = _dets(spark, sf).select(F.concat_ws("-", "image_id", "idx").alias("nonce"), F.col("x").alias("x"), (F.col("y") * 2).alias("y"), F.lit(50.0).alias("width"), F.lit(20.0).alias("height"))
    return C.nested_frames(f, inner)


def frame_routes(spark, sf):
    target = F.concat(F.lit("el_"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string"), F.lit("_"))).otherwise(""), F.col("event_id").cast("string"))
    return table(spark, sf, "events").groupBy(C.frame_number_of(target).alias("frame")).agg(F.count("*").alias("n"))


def richest_captures(spark, sf):
    n = _dets(spark, sf).groupBy(F.col("image_id").alias("id"), (F.col("image_id") % 100).alias("session")).agg(F.count_if(F.col("conf") >= 0.5).alias("n"))
    return S.most_vision_only(n, "session", "n")


def field_fill(spark, sf):
    o = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("form"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("key")).agg(F.min("l_shipdate").alias("d"), F.min("l_suppkey").alias("s"))
    value = F.date_format("d", "yyyy-MM-dd")
    return S.field_fill(o.select("form", "key", value.alias("value")), o.where("s % 5 <> 0").select("form", "key", F.when(F.col("s") % 7 == 0, "?").otherwise(value).alias("value"))).select("form", "filled", F.array_join("wrong", ",").alias("wrong"))


def control_texts(spark, sf):
    lines = _dets(spark, sf).select("image_id", (F.col("x") + F.col("idx") / 10).alias("x"), "y", F.lit(30.0).alias("width"), F.lit(8.0).alias("height"), F.concat(F.lit("line "), F.col("idx").cast("string")).alias("text"))
    return C.control_labels(lines, "image_id")


def reading_times(spark, sf):
    d = _dets(spark, sf)
    reads = d.select("image_id", F.when(F.col("idx") % 3 > 0, F.col("idx")).alias("lines"), F.when(F.col("idx") % 3 > 0, F.col("width").cast("long")).alias("ms"))
    times = F.struct(F.col("width").alias("latencyMs"), F.when(F.col("idx") % 2 == 0, F.col("height")).alias("uiLatencyMs"), F.lit(None).cast("double").alias("ocrLatencyMs"))
    device = d.groupBy("image_id").agg(F.sum(C.device_ms(times)).alias("device_ms"))
    return C.ocr_totals(reads, "image_id").join(device, "image_id")


def vision_cells(spark, sf):
    cell = P.vision_cell(F.col("x") + F.col("idx"), F.col("y"), F.when(F.col("cls") > 0, F.col("cls")))
    return _dets(spark, sf).groupBy("image_id").agg(F.count_distinct(cell).alias("cells"), F.min(cell).alias("first"))


def all_elements(spark, sf):
    d = _dets(spark, sf)
    dom = d.where("conf < 0.5").select("image_id", F.concat(F.lit("el_"), F.col("idx").cast("string")).alias("id"))
    return C.all_regions(dom, d.where("conf >= 0.3").select("image_id", F.concat(F.lit("vis_"), F.col("idx").cast("string")).alias("id"))).groupBy("image_id").agg(F.count("*").alias("elements"), F.count_if(F.startswith("id", F.lit("vis_"))).alias("seen"))


def default_details(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    defaults = spark.createDataFrame([("name", "Name", 0), ("email", "Email", 1)], "key string, label string, pos int").coalesce(1)
    own = c.select(k.alias("person_id"), F.when(k % 2 == 0, "email").otherwise("size").alias("key"), F.lit("Own").alias("label"), k.cast("string").alias("value"), F.lit(0).alias("pos"))
    return profile.with_defaults(defaults, own)


def step_times(spark, sf):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    begin = V.parse_time(F.when(F.col("event_id") % 10 == 0, "soon").otherwise(at))
    return table(spark, sf, "events").select("event_id", V.duration_ms(begin, V.parse_time(F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 90 SECONDS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))).alias("ms"))


def skipped_fields(spark, sf):
    e = F.col("event_id")
    element = lambda i: F.struct(F.lit(f"el_{i}").alias("id"), F.lit("textbox").alias("role"), F.lit("").alias("label"), B.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), F.create_map(F.lit("filled"), F.lit("yes"), F.lit("name"), F.lit("n")).alias("attributes"), F.lit(True).alias("isVisible"), F.lit(True).alias("isInteractive"), F.lit(None).cast("boolean").alias("redacted"))
    rows = table(spark, sf, "events").withColumn("elements", F.array(element(0), element(1), element(2)).cast(f"array<{schema.ELEMENT}>"))
    marked = C.set_attribute(F.col("elements"), F.array(F.concat(F.lit("el_"), (e % 3).cast("string"))), "filled", "skipped")
    return rows.select("event_id", F.array_join(F.transform(marked, lambda x: F.concat_ws("/", x["attributes"]["filled"], x["attributes"]["name"])), ",").alias("state"))


def approvals(spark, sf):
    """Clicks as requests and views as answers of a user; an answer within two minutes decides."""
    e = table(spark, sf, "events")
    r = streaming.approvals(e.where("event_type = 'click'").select("event_id", F.col("user_id").alias("session"), "ts"), e.where("event_type = 'view'").select(F.col("user_id").alias("session"), "ts", (F.col("event_id") % 2 == 0).alias("allow")))
    a = streaming.given_answers(e.where("event_type = 'signup'").select("event_id", F.col("user_id").alias("session"), "ts"), e.where("event_type = 'view'").select(F.col("user_id").alias("session"), "ts", F.lit("fill").alias("kind")))
    return r.groupBy("event_id").agg(F.max("allowed").cast("string").alias("outcome")).unionByName(a.groupBy("event_id").agg(F.max("outcome").alias("outcome")))


def sql_functions(spark, sf):
    pii.register_sql(spark)
    return spark.sql("SELECT page_id, scrub_url(url) AS url, pii_mask(concat('mail a', page_id, '@b.org now')) AS masked, size(pii_spans('call (415) 555-0132 today')) AS spans FROM {pages}", pages=table(spark, sf, "pages"))


def decoded_images(spark, sf):
    data = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("!"), F.col("text"))).otherwise(sources.encode_base64(F.col("text").cast("binary")))
    return table(spark, sf, "documents").select("doc_id", F.octet_length(sources.decode_base64(data)).alias("bytes"))


def capture_log(spark, sf):
    """Captures written as a log of one file <id>.json a step, and read back through read_captures."""
    path = _folder(spark, "captures")
    c = table(spark, sf, "conversations")
    text = F.coalesce(F.col("text"), F.lit(""))
    sources.write_captures(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("sessionId"), F.col("turn").cast("int").alias("stepIndex"), text.alias("task")), path)
    log = sources.read_captures(spark, path)
    return log.groupBy(F.col("sessionId").alias("session")).agg(F.count("*").alias("steps"), F.sum(F.length("task")).alias("chars"), F.sum("id").alias("ids"))


def label_files(spark, sf):
    """All images' boxes written as label files <image_id>.txt and read back, each task's in turns."""
    contents = sources.label_contents(_dets(spark, sf).withColumn("vw", F.lit(400.0)).withColumn("vh", F.lit(300.0)))
    back = sources.label_lines(sources.through_own_files(contents, _folder(spark, "labels"), ".txt"))
    return back.groupBy(F.col("image_id").cast("long").alias("image_id")).agg(F.count("*").alias("boxes"), F.round(F.sum("w"), 5).alias("width"), F.sum(F.col("line_no") * F.col("cls")).alias("classes"))


def screenshots(spark, sf):
    """Screenshots saved beside the log, joined to their captures by the file's stem."""
    path = _folder(spark, "shots")
    c = table(spark, sf, "conversations").where("turn % 3 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("name"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    for kind, suffix in ((0, ".png"), (1, ".webp"), (2, ".jpg")):
        sources.write_named(c.where(F.crc32("name") % 3 == kind), f"{path}/{kind}", suffix)
    shots = sources.read_screenshots(spark, f"{path}/*")
    ids = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    joined = ids.join(shots, F.col("id").cast("string") == F.col("stem"), "left")
    return joined.select("id", F.col("mime").isNotNull().alias("has_shot"), F.octet_length("content").cast("int").alias("bytes"))


def page_fixtures(spark, sf):
    """Labelled page fixtures written as files <page>.json and read back as boxes by role, each task's in turns."""
    d = _dets(spark, sf).withColumn("bbox", B.box("x", "y", "width", "height")).withColumn("label", F.concat(F.lit("no. "), F.col("idx").cast("string")))
    of = lambda cls, item: F.transform(F.sort_array(F.collect_list(F.when(F.col("cls") == cls, F.struct("idx", "label", "bbox")))), item)
    named = lambda e: F.struct(e["label"].alias("label"), e["bbox"].alias("bbox"))
    pages = d.groupBy("image_id").agg(of(0, named).alias("links"), of(1, named).alias("buttons"), of(2, lambda e: e["bbox"]).alias("frames"))
    viewport = F.struct(F.lit(400.0).alias("width"), F.lit(300.0).alias("height")).alias("viewport")
    contents = pages.select("image_id", F.to_json(F.struct(viewport, "links", "buttons", "frames")))
    back = sources.fixture_lines(sources.through_own_files(contents, _folder(spark, "fixtures"), ".json"))
    return back.groupBy(F.col("page").cast("long").alias("page"), "role").agg(F.count("*").alias("boxes"), F.sum(F.col("pos") * F.col("width")).alias("weight"), F.max("label").alias("label"), F.max("vw").alias("vw"))


def result_sinks(spark, sf):
    """Counts written both as JSON rows and as a table, and read back."""
    path = _folder(spark, "results")
    sources.write_results(table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")), path)
    return spark.read.schema("event_type string, n long").json(f"{path}/json").join(spark.read.parquet(f"{path}/table").withColumnRenamed("n", "m"), "event_type")


def recorded_steps(spark, sf):
    """A stream over written steps, each recorded once with its outcome."""
    path = _folder(spark, "steps")
    table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_type") == "error", "boom").alias("error")).write.parquet(f"{path}/in")
    arriving = spark.readStream.schema("event_id long, event_type string, error string").parquet(f"{path}/in")
    streaming.record_stream(arriving, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("outcome").agg(F.count("*").alias("steps"))


def sanitised_stream(spark, sf):
    """Captures that arrive as files, sanitised by the stream and appended to a table."""
    path = _folder(spark, "arriving")
    _captures(spark, sf).write.parquet(f"{path}/in")
    arriving = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    streaming.sanitise_stream(arriving, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("sessionId", "stepIndex", F.col("page.title").alias("title"), F.col("page.url").alias("url"))


QUERIES = {f.__name__: f for f in (
    hidden_lines, typed_values, hidden_text, field_regions, kept_nodes, photo_regions, judged_points, saved_names, allowed_details, readable_lines, unread_frames, viewed_frames, nested_frames,
    frame_routes, richest_captures, field_fill, control_texts, reading_times, vision_cells, all_elements, default_details, step_times, skipped_fields, approvals, sql_functions, decoded_images,
    capture_log, label_files, screenshots, page_fixtures, result_sinks, recorded_steps, sanitised_stream,
)}

_D = f"({duck(DETS)})"
_F = f"(SELECT image_id AS page_id, idx AS frame_no, x - 50 AS x, y - 30 AS y, width, height FROM {_D})"


def _case(words, number: str) -> str:
    return f"(CASE {number} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END)"


_LINES = "(SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_FIRST = "list_sort(list_concat(list_transform(cards, lambda v: printf('%09d', strpos(t0, v)) || 'payment_card'), list_transform(emails, lambda v: printf('%09d', strpos(t0, v)) || 'email'), list_transform(phones, lambda v: printf('%09d', strpos(t0, v)) || 'phone')))[1][10:]"
_LINE = r"coalesce(" + _FIRST + r", CASE WHEN regexp_matches(t0, '\d([\s-]?\d){8,}') THEN 'pii_text' WHEN regexp_matches(t0, '[^\s]+\s?@\s?[^\s]+\.[^\s]{2,}') THEN 'email' END)"
_SHOWN = "CASE c WHEN 'payment_card' THEN '[HIDDEN CARD NUMBER]' WHEN 'email' THEN '[HIDDEN EMAIL]' WHEN 'phone' THEN '[HIDDEN PHONE]' WHEN 'pii_text' THEN '[HIDDEN NUMBER]' ELSE t0 END"
_CLIPPED = "greatest(x, 0) AS cx, greatest(y, 0) AS cy, least(x + width, 220) - greatest(x, 0) AS cw, least(y + height, 90) - greatest(y, 0) AS ch"

_TITLE = f"(WITH {_pii('(SELECT conv_id, turn, text[1:60] AS text FROM conversations)', 'conv_id, turn', *['[REDACTED]'] * 3)} SELECT conv_id, turn, t3 AS title FROM h)"
_BODY = f"(WITH {_pii('conversations', 'conv_id, turn')} SELECT conv_id, turn, t3 AS body FROM h)"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_PAGE = "concat('Page: \"', CASE WHEN length({0}) <= 80 THEN {0} ELSE {0}[1:79] || '…' END, '\" (https://chat.example.org/c/', conv_id, '?[REDACTED])')".format("trim(regexp_replace(title, '\\s+', ' ', 'g'))")
_HELD = f"(SELECT c.conv_id, c.turn, c.text, {_STRIP.format('c.text')} AS task, title, body, {_STRIP.format('body')} AS shown FROM conversations c JOIN {_TITLE} t USING (conv_id, turn) JOIN {_BODY} b USING (conv_id, turn))"
_CLICKED = 'Already clicked: "Submit order". Do not click these again unless the task asks for more than one or a page message says it is still needed.'

ORACLE_SQL = {
    "sanitised_texts": f"""SELECT conv_id::VARCHAR AS "sessionId", turn::INT AS "stepIndex", title, body AS "pageText" FROM {_TITLE} JOIN {_BODY} USING (conv_id, turn)""",
    "action_prompts": f"""SELECT conv_id::VARCHAR AS "sessionId", turn::INT AS "stepIndex", concat_ws(chr(10), concat('Task: ', CASE WHEN task = '' THEN '(none given)' ELSE task END), '', {_PAGE},
        'Viewport: 640x480 CSS px. Locations are approximate: a 3x3 grid word, then x, y, width, height.', concat('Step: ', turn), 'Previous actions (all already done successfully):', '  1. click el_1 "Submit order"', '{_CLICKED}',
        'Saved details (values hidden; type one by using its placeholder as the text):', '  {{{{email}}}} = Email', 'Empty fields still to fill, in order (fill the first one that has a matching saved detail):', '  el_0 "Search"',
        'Redacted regions: 1 area(s) hidden for privacy; their contents are unavailable.', CASE WHEN turn % 2 <> 0 THEN 'Screenshot: not provided; rely on the element list.' END, '', 'UI elements (id | role | label | location [notes]):',
        'el_0 | textbox | "Search" | top-left (x=0, y=0, w=30, h=20) [type=text]', 'el_1 | button | "Submit order" | top-left (x=40, y=30, w=30, h=20) [type=submit]', '(1 more elements omitted)', '',
        'Choose the single next action. Reply with ONLY the JSON object.') AS prompt FROM {_HELD}""",
    "question_prompts": f"""SELECT conv_id::VARCHAR AS "sessionId", turn::INT AS "stepIndex", concat_ws(chr(10), concat('Question: ', CASE WHEN task = '' THEN 'Describe this page.' ELSE task END), '', {_PAGE},
        concat('Hidden on the user''s device before sending: ', CASE WHEN turn % 2 = 0 THEN '1 face.' ELSE '1 email address.' END), '', 'Buttons, links and fields on screen:', '  - textbox (text): Search', '  - button: Submit order', '',
        CASE WHEN shown = '' THEN 'Visible page text: not provided.' ELSE concat('Visible page text:', chr(10), '\"\"\"', chr(10), CASE WHEN length(shown) > 6000 THEN shown[1:6000] || {"'" + T.ASK_TEXT_MARK.replace("'", "''") + "'"} ELSE shown END, chr(10), '\"\"\"') END, '', 'Answer the question.') AS prompt FROM {_HELD}""",
    "sensitive_lines": f"WITH {_pii(_LINES, 'doc_id, i')}, s AS (SELECT doc_id, {_LINE} AS category FROM h) SELECT doc_id, category, count(*) AS lines FROM s WHERE category IS NOT NULL GROUP BY ALL",
    "hidden_lines": f"WITH {_pii(_LINES, 'doc_id, i')}, s AS (SELECT doc_id, i, t0, {_LINE} AS c FROM h) SELECT doc_id, string_agg({_SHOWN}, chr(10) ORDER BY i) AS shown FROM s GROUP BY doc_id",
    "typed_values": """WITH t AS (SELECT c_custkey, c_custkey % 7 AS k, c_custkey % 3 AS v, c_custkey % 5 = 0 AS own FROM customer)
      SELECT c_custkey, CASE WHEN k = 4 THEN CASE WHEN own THEN 'pii_text' END WHEN k IN (3, 5) OR v = 1 THEN NULL WHEN v = 0 THEN 'email' WHEN k = 2 THEN 'phone' WHEN k = 1 THEN 'email' WHEN own THEN 'pii_text' END AS category FROM t""",
    "hidden_text": f"WITH {_pii('documents', 'doc_id')} SELECT doc_id, greatest(doc_id % 4, len(cards) + len(emails) + len(phones))::INT AS hidden FROM h",
    "field_regions": f"""WITH e AS (SELECT *, CASE WHEN x = 0 OR idx % 4 IN (0, 3) THEN 'credential' WHEN idx % 4 = 1 THEN 'payment_card' END AS category FROM {_D} WHERE cls = 0 AND idx % 3 <> 0),
      r AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE x > 100) SELECT image_id, category, count(*) AS n, sum(width) AS width FROM r WHERE category IS NOT NULL GROUP BY ALL""",
    "kept_nodes": f"""SELECT image_id, count(*) FILTER ((x <= 200 AND y <= 100 OR cls IN (0, 1)) AND NOT (cls = 2 AND idx % 2 = 0)) AS kept, count(*) FILTER (x < 200 AND y < 100) AS comparable FROM {_D} GROUP BY image_id""",
    "photo_regions": f"""WITH e AS (SELECT *, {_case(TAGS, '(x / 40)::INT % 5')} AS tag FROM {_D})
      SELECT image_id AS page_id, count(*) AS photos, sum(width) AS width FROM e WHERE height - 25 >= 20 AND width >= 20 AND
        (((tag IN ('img', 'video') OR (tag = 'picture' AND idx % 2 <> 0) OR idx % 4 = 1) AND tag <> 'svg') OR y = 0) GROUP BY image_id""",
    "judged_points": f"""WITH p AS (SELECT *, CASE WHEN x > 0 THEN cls END AS node FROM {_D})
      SELECT image_id, idx, CASE WHEN node IS NULL THEN 'nothing' WHEN y = 30 THEN 'disabled' WHEN y = 60 THEN 'listed' WHEN x = 80 THEN 'sensitive' WHEN idx % 2 <> 0 AND idx % 3 <> 0 THEN 'not clickable'
        WHEN row_number() OVER (PARTITION BY image_id, node ORDER BY idx) > 1 AND idx % 3 <> 0 THEN 'claimed' END AS reason FROM p""",
    "saved_names": "SELECT c_custkey AS person_id, 'doc' AS key, CASE WHEN c_custkey % 2 = 0 THEN 'Document (file to upload)' ELSE 'Document' END AS label FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0",
    "allowed_details": """SELECT c_custkey AS person_id, CASE c_custkey % 5 WHEN 0 THEN 'shoe_size' WHEN 2 THEN 'pin_code' ELSE 'shirt_size' END AS key, CASE c_custkey % 5 WHEN 0 THEN 'Shoe size' WHEN 2 THEN 'PIN code' ELSE 'Shirt size' END AS label
      FROM customer WHERE c_custkey % 5 IN (0, 2) OR c_custkey % 5 = 4 AND c_custkey % 2 <> 0""",
    "readable_lines": f"SELECT image_id, idx, 'Total' AS text, floor(conf * 1000 + 0.5) / 1000 AS confidence FROM {_D} WHERE idx % 4 <> 0 AND conf >= 0.5",
    "unread_frames": f"SELECT page_id, x, y, width, height, 'other' AS category, 1.0::DOUBLE AS confidence, 'ocr' AS method FROM {_F} WHERE frame_no % 3 = 0",
    "viewed_frames": f"SELECT page_id, frame_no, cx AS x, cy AS y, cw AS width, ch AS height FROM (SELECT *, {_CLIPPED} FROM {_F}) WHERE cw >= 20 AND ch >= 20",
    "nested_frames": f"""WITH f AS (SELECT page_id, frame_no, x, y, width, height FROM {_F}), n AS (SELECT image_id, idx, x AS nx, y * 2 AS ny FROM {_D}),
      m AS (SELECT page_id, greatest(x, nx + x + 2) AS l, greatest(y, ny + y + 2) AS t, least(x + width, nx + x + 52) AS r, least(y + height, ny + y + 22) AS b FROM f JOIN n ON page_id = image_id AND frame_no = idx)
      SELECT page_id, l AS x, t AS y, r - l AS width, b - t AS height FROM m WHERE r > l AND b > t""",
    "frame_routes": "SELECT (event_id % 3)::INT AS frame, count(*) AS n FROM events GROUP BY 1",
    "richest_captures": f"""WITH c AS (SELECT image_id AS id, image_id % 100 AS session, count(*) FILTER (conf >= 0.5) AS n FROM {_D} GROUP BY image_id)
      SELECT session, arg_max(id, (n, -id)) AS id, max(n) AS n FROM c GROUP BY session""",
    "field_fill": """WITH o AS (SELECT l_orderkey AS form, 'k' || l_linenumber AS key, min(l_suppkey) AS s FROM lineitem GROUP BY ALL)
      SELECT form, concat(count(*) FILTER (s % 5 <> 0 AND s % 7 <> 0), '/', count(*)) AS filled, coalesce(string_agg(key, ',' ORDER BY key) FILTER (s % 5 = 0 OR s % 7 = 0), '') AS wrong FROM o GROUP BY form""",
    "control_texts": f"SELECT image_id, string_agg('line ' || idx, ' ' ORDER BY floor((y + 4) / 8 + 0.5), x + idx / 10)[1:80] AS label FROM {_D} GROUP BY image_id",
    "reading_times": f"""SELECT image_id, coalesce(sum(idx) FILTER (idx % 3 > 0), 0)::BIGINT AS lines, coalesce(sum(width::BIGINT) FILTER (idx % 3 > 0), 0)::BIGINT AS ms, sum(width + CASE WHEN idx % 2 = 0 THEN height ELSE 0 END) AS device_ms FROM {_D} GROUP BY image_id""",
    "vision_cells": f"""WITH c AS (SELECT image_id, concat_ws(':', CASE WHEN cls > 0 THEN cls::VARCHAR END, floor((x + idx) / 16 + 0.5)::BIGINT::VARCHAR, floor(y / 16 + 0.5)::BIGINT::VARCHAR) AS cell FROM {_D})
      SELECT image_id, count(DISTINCT cell) AS cells, min(cell) AS first FROM c GROUP BY image_id""",
    "all_elements": f"SELECT image_id, count(*) FILTER (conf < 0.5) + count(*) FILTER (conf >= 0.3) AS elements, count(*) FILTER (conf >= 0.3) AS seen FROM {_D} GROUP BY image_id HAVING count(*) FILTER (conf < 0.5 OR conf >= 0.3) > 0",
    "default_details": """WITH p AS (SELECT c_custkey AS person_id, c_custkey % 2 = 0 AS e FROM customer)
      SELECT person_id, 'name' AS key, 'Name' AS label, '' AS value, 0 AS position FROM p UNION ALL SELECT person_id, 'email', 'Email', CASE WHEN e THEN person_id::VARCHAR ELSE '' END, 1 FROM p
      UNION ALL SELECT person_id, 'size', 'Own', person_id::VARCHAR, 2 FROM p WHERE NOT e""",
    "step_times": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 90000 END::BIGINT AS ms FROM events",
    "skipped_fields": "SELECT event_id, array_to_string(list_transform([0, 1, 2], lambda i: CASE WHEN event_id % 3 = i THEN 'skipped/n' ELSE 'yes/n' END), ',') AS state FROM events",
    "approvals": """SELECT c.event_id, coalesce(bool_or(v.event_id % 2 = 0), false)::VARCHAR AS outcome FROM events c LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = c.user_id AND v.ts BETWEEN c.ts AND c.ts + INTERVAL 120 SECOND WHERE c.event_type = 'click' GROUP BY c.event_id
      UNION ALL SELECT c.event_id, max(CASE WHEN v.event_id IS NULL THEN 'stop' ELSE 'fill' END) FROM events c LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = c.user_id AND v.ts BETWEEN c.ts AND c.ts + INTERVAL 600 SECOND WHERE c.event_type = 'signup' GROUP BY c.event_id""",
    "sql_functions": r"""SELECT page_id, concat(regexp_extract(url, '^https?://[^/?#]+'), coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/'),
        CASE WHEN regexp_matches(url, '\?[^#]') THEN '?[REDACTED]' ELSE '' END, CASE WHEN regexp_matches(url, '#.') THEN '#[REDACTED]' ELSE '' END) AS url, 'mail [REDACTED] now' AS masked, 1 AS spans FROM pages""",
    "decoded_images": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN strlen(text) END::INT AS bytes FROM documents",
    "capture_log": "SELECT conv_id::VARCHAR AS session, count(*) AS steps, coalesce(sum(length(text)), 0)::BIGINT AS chars, sum(conv_id * 1000 + turn)::BIGINT AS ids FROM conversations GROUP BY conv_id",
    "label_files": f"SELECT image_id, count(*) AS boxes, round(sum(round(width / 400, 6)), 5) AS width, sum((idx - 1) * cls)::BIGINT AS classes FROM {_D} GROUP BY image_id",
    "screenshots": "SELECT conv_id * 1000 + turn AS id, turn % 3 = 0 AS has_shot, CASE WHEN turn % 3 = 0 THEN coalesce(strlen(text), 0) END::INT AS bytes FROM conversations",
    "page_fixtures": f"""SELECT image_id AS page, CASE cls WHEN 0 THEN 'link' WHEN 1 THEN 'button' ELSE 'frame' END AS role, count(*) AS boxes, sum(pos * width) AS weight, CASE WHEN cls < 2 THEN max('no. ' || idx) END AS label, 400.0::DOUBLE AS vw
      FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY idx) - 1 AS pos FROM {_D}) GROUP BY image_id, cls""",
    "sanitised_stream": f"""SELECT conv_id::VARCHAR AS "sessionId", turn::INT AS "stepIndex", title, concat('https://chat.example.org/c/', conv_id, '?[REDACTED]') AS url FROM {_TITLE}""",
    "result_sinks": "SELECT event_type, count(*) AS n, count(*) AS m FROM events GROUP BY event_type",
    "recorded_steps": "SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, count(*) AS steps FROM events GROUP BY 1",
}
