"""Captures: sanitising steps, regions and masks, contract checks, frames, summaries and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from pagewarden import schema
from pagewarden.functions import boxes as B
from pagewarden.functions import pii
from pagewarden.functions import text as T
from pagewarden.functions import values as V
from pagewarden.operators import sessions as S

# Words and enumerations of the contract.
CATEGORY_WORDS = {
    "face": "face", "photo": "photo", "credential": "password or other secret field", "payment_card": "card number", "email": "email address",
    "phone": "phone number", "pii_text": "ID number", "address": "address", "other": "other sensitive item",
}
ROLES = ("button", "link", "textbox", "checkbox", "radio", "select", "option", "image", "heading", "text", "other")
CATEGORIES = ("pii_text", "credential", "payment_card", "face", "photo", "address", "email", "phone", "other")
METHODS = ("ml", "heuristic", "dom", "ocr")
ACTIONS = ("click", "type", "scroll", "navigate", "wait", "done", "ask_user", "noop")
MIMES = ("image/png", "image/jpeg", "image/webp")
PROTOCOL_MAJOR = "0"
_SURFACES = {"canvas": ", drawn on a canvas", "frame": ", inside an embedded frame", "image": ", part of an image"}


def dom_regions(elements: DataFrame) -> DataFrame:
    """Regions of visible sensitive fields (key columns, box columns, category, confidence 1, method dom)."""
    e = elements.withColumn("category", pii.field_category(F.col("role"), F.col("label"), F.col("attributes")))
    return e.where("is_visible AND category IS NOT NULL").select("image_id", "x", "y", "width", "height", "category", F.lit(1.0).alias("confidence"), F.lit("dom").alias("method"))


def all_regions(*sources: DataFrame) -> DataFrame:
    """Every source's regions; nothing is merged."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def masks(regions: DataFrame, space: str = "css") -> DataFrame:
    """Padded masks in css pixels of regions with dpr, img_w, img_h (screenshot pixels); what ends outside is dropped.

    Detector regions (method ml) come in screenshot pixels, others in css pixels.
    """
    b = B.box("x", "y", "width", "height")
    px = B.either(F.col("method") == "ml", b, B.to_px(b, F.col("dpr")))
    # Edges are columns of their own: each is computed once, and no struct is made of them before they are told.
    edges = zip(("_x0", "_y0", "_x1", "_y1"), B.region_edges(px, F.col("method"), F.col("img_w"), F.col("img_h")))
    padded = regions.select("image_id", "category", "confidence", "method", "dpr", *(e.alias(n) for n, e in edges)).where("_x1 > _x0 AND _y1 > _y0")
    m = B.box("_x0", "_y0", F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    out = B.to_css(m, F.col("dpr")) if space == "css" else m
    return padded.select("image_id", *(out[k].alias(k) for k in ("x", "y", "width", "height")), "category", "confidence", "method")


def pad_css_regions(redactions: Column, viewport: Column) -> Column:
    """An array of css regions padded as painted at the viewport's pixel ratio."""
    dpr = F.when(viewport["devicePixelRatio"] > 0, viewport["devicePixelRatio"]).otherwise(1.0)
    w, h = viewport["width"] * dpr, viewport["height"] * dpr

    # A step an array: its elements are computed once, however often the next step reads them.
    px = F.transform(redactions, lambda r: r.withField("bbox", B.to_px(r["bbox"], dpr)))
    padded = F.transform(px, lambda r: r.withField("bbox", B.pad_region(r["bbox"], r["method"], w, h)))
    inside = F.filter(padded, lambda r: r["bbox"].isNotNull())
    return F.transform(inside, lambda r: r.withField("bbox", B.to_css(r["bbox"], dpr)))


def sanitise(captures: DataFrame) -> DataFrame:
    """Captures fit to leave: scrubbed url, masked title, elements and page text, sensitive fields as padded regions.

    Without a screenshot regions are reported unpadded and detector regions dropped. Works on streams too.
    """
    visible = F.filter(F.col("elements"), lambda e: e["isVisible"])
    judged = F.transform(
        visible,
        lambda e: F.struct(e["bbox"].alias("bbox"), pii.field_category(e["role"], e["label"], e["attributes"]).alias("category"), F.lit(1.0).alias("confidence"), F.lit("dom").alias("method")),
    )
    found = F.filter(judged, lambda r: r["category"].isNotNull())
    regions = F.concat(F.coalesce(F.col("redactions"), F.array()), found)
    unpainted = F.filter(regions, lambda r: r["method"] != "ml")
    page = F.col("page").withField("url", pii.scrub_url(F.col("page.url"))).withField("title", pii.mask(F.col("page.title")))
    return (
        captures.withColumn("redactions", F.when(F.col("screenshot").isNotNull(), pad_css_regions(regions, F.col("viewport"))).otherwise(unpainted))
        .withColumn("elements", pii.redact_elements(F.col("elements")))
        .withColumn("page", page)
        .withColumn("pageText", pii.mask_labelled(F.col("pageText")))
    )


def count_regions(regions: DataFrame, *by: str) -> DataFrame:
    """Per group: redactions by method, photos by their category: faces, photos, fields, text, ocr."""
    key = F.when(F.col("category") == "photo", "photo").otherwise(F.col("method"))
    names = {"ml": "faces", "photo": "photos", "dom": "fields", "heuristic": "text", "ocr": "ocr"}
    return regions.groupBy(*by).agg(*(F.count_if(key == k).cast("int").alias(n) for k, n in names.items()))


def describe_redactions(regions: DataFrame, by: str, pos: str) -> DataFrame:
    """Per group "1 face, 2 email addresss": categories in order of first sight, a plain s for the plural."""
    word = F.coalesce(*(F.when(F.col("category") == k, w) for k, w in CATEGORY_WORDS.items()), F.col("category"))
    counts = regions.groupBy(by, "category").agg(F.count("*").alias("n"), F.min(pos).alias("at"))
    phrase = F.concat(F.col("n").cast("string"), F.lit(" "), word, F.when(F.col("n") == 1, "").otherwise("s"))
    return counts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", phrase.alias("p")))), lambda x: x["p"]), ", ").alias("hidden"))


def describe_regions(redactions: Column) -> Column:
    """The same of an array of regions; "nothing" of none."""
    names = F.array_distinct(F.transform(redactions, lambda r: r["category"]))
    word = lambda c: F.coalesce(*(F.when(c == k, w) for k, w in CATEGORY_WORDS.items()), c)

    def phrase(c: Column) -> Column:
        n = F.size(F.filter(redactions, lambda r: r["category"] == c))
        return F.concat(n.cast("string"), F.lit(" "), word(c), F.when(n == 1, "").otherwise("s"))

    return F.when(F.size(redactions) > 0, F.array_join(F.transform(names, phrase), ", ")).otherwise("nothing")


def same_major(version: Column) -> Column:
    return F.coalesce(F.split_part(version, F.lit("."), F.lit(1)) == PROTOCOL_MAJOR, F.lit(False))


def violations(capture: str = "") -> Column:
    """Names of the contract's rules that a capture breaks; none: valid."""
    c = lambda n: F.col(f"{capture}.{n}" if capture else n)
    yes = lambda x: F.coalesce(x, F.lit(False))
    box_ok = lambda b: (b["width"] >= 0) & (b["height"] >= 0) & b["x"].isNotNull() & b["y"].isNotNull()
    every = lambda arr, ok: yes(F.forall(arr, lambda x: yes(ok(x))))
    rules = {
        "protocolVersion": yes(c("protocolVersion").rlike(r"^\d+\.\d+\.\d+$")),
        "sessionId": yes(F.length(c("sessionId")) >= 1),
        "stepIndex": yes(c("stepIndex") >= 0),
        "task": c("task").isNotNull(),
        "page": yes(c("page")["url"].isNotNull() & c("page")["title"].isNotNull() & F.try_to_timestamp(c("page")["capturedAt"]).isNotNull()),
        "viewport": yes((c("viewport")["width"] >= 0) & (c("viewport")["height"] >= 0) & (c("viewport")["devicePixelRatio"] > 0)),
        "elements": every(c("elements"), lambda e: (F.length(e["id"]) >= 1) & e["role"].isin(*ROLES) & e["label"].isNotNull() & box_ok(e["bbox"]) & e["isVisible"].isNotNull() & e["isInteractive"].isNotNull()),
        "screenshot": c("screenshot").isNull() | yes(c("screenshot")["mimeType"].isin(*MIMES) & (c("screenshot")["width"] >= 1) & (c("screenshot")["height"] >= 1)),
        "redactions": every(c("redactions"), lambda r: box_ok(r["bbox"]) & r["category"].isin(*CATEGORIES) & r["confidence"].between(0, 1) & r["method"].isin(*METHODS)),
        "history": every(c("history"), valid_command),
        "perception": yes(c("perception")["modelId"].isNotNull() & (c("perception")["latencyMs"] >= 0)),
        "pageText": c("pageText").isNull() | (F.length(c("pageText")) <= 20_000),
        "profileFields": c("profileFields").isNull() | (yes(F.size(c("profileFields")) <= 60) & every(c("profileFields"), lambda f: f["key"].rlike("^[a-z0-9_]{1,40}$") & (F.length(f["label"]) <= 60))),
    }
    return F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())


def _nodes(kind: K.DataType, path: tuple[str, ...] = ()):
    """(path of field names, [] for an array's items; the names it may have) of each object of a type; maps may have any."""
    if isinstance(kind, K.ArrayType):
        yield from _nodes(kind.elementType, (*path, "[]"))
    elif isinstance(kind, K.StructType):
        yield path, kind.fieldNames()
        for f in kind:
            yield from _nodes(f.dataType, (*path, f.name))


def _keys_at(v: Column, path: tuple[str, ...]) -> Column:
    """The keys of the objects at a path of a variant; none where something else stands there."""
    head = path.index("[]") if "[]" in path else len(path)
    kind = "map<string,variant>"
    for step in reversed(path[head:]):
        kind = f"array<{kind}>" if step == "[]" else f"struct<`{step}`:{kind}>"
    found = F.try_variant_get(v, "$" + "".join(f".{s}" for s in path[:head]), kind)

    def within(x: Column, steps: tuple[str, ...]) -> Column:
        if not steps:
            return F.map_keys(x)
        if steps[0] == "[]":
            return F.flatten(F.filter(F.transform(x, lambda y: within(y, steps[1:])), lambda k: k.isNotNull()))
        return within(x[steps[0]], steps[1:])

    return F.coalesce(within(found, path[head:]), F.array().cast("array<string>"))


def unknown_keys(raw: Column) -> Column:
    """Paths of the keys of a raw JSON capture, at any level, that the contract does not have: page.x, elements[].bbox.y."""
    v, out = F.try_parse_json(raw), []
    for path, names in _nodes(K.StructType.fromDDL(schema.CAPTURE)):
        prefix = "".join(s if s == "[]" else f".{s}" for s in path).lstrip(".")
        extra = F.array_except(_keys_at(v, path), F.array(*map(F.lit, names)))
        out.append(F.transform(extra, lambda k: F.concat(F.lit(f"{prefix}." if prefix else ""), k)))  # noqa: B023
    return F.array_sort(F.concat(*out))


def split_valid(captures: DataFrame, raw: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid captures of the protocol's major version, rejects with their violations).

    ``raw`` is the column of the JSON that a capture was read from: its unknown keys are violations as well.
    """
    none = F.array().cast("array<string>")
    major = F.when(same_major(F.col("protocolVersion")), none).otherwise(F.array(F.lit("protocol major")))
    unknown = F.transform(F.coalesce(unknown_keys(F.col(raw)), none), lambda k: F.concat(F.lit("unknown: "), k)) if raw else none
    marked = captures.withColumn("violations", F.concat(violations(), major, unknown))
    return marked.where("size(violations) = 0").drop("violations"), marked.where("size(violations) > 0")


def valid_command(c: Column) -> Column:
    """Has a command what its action requires, within bounds?"""
    some = lambda k: F.coalesce(F.length(c[k]) >= 1, F.lit(False))
    there = lambda k: c[k].isNotNull()
    by_action = {
        "click": some("target"), "type": some("target") & there("text"), "scroll": F.coalesce(c["direction"].isin("up", "down"), F.lit(False)) & (c["amountPx"].isNull() | (c["amountPx"] >= 0)),
        "navigate": there("url"), "wait": F.coalesce(c["ms"] >= 0, F.lit(False)), "done": there("summary"), "ask_user": there("question"), "noop": there("reason"),
    }
    out = F.lit(False)
    for action, ok in by_action.items():
        out = F.when(c["action"] == action, ok).otherwise(out)
    return F.coalesce(out & (c["confidence"].isNull() | c["confidence"].between(0, 1)), F.lit(False))


def merge_frames(pages: DataFrame, frames: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged elements, unread frames).

    ``pages`` (page_id, pos, id, box, is_visible), ``frames`` (page_id, frame_no, nonce, box, origin_x,
    origin_y), ``inner`` (nonce, pos, id, box, is_visible). A frame's elements are moved to its place and
    come before the first page element at or under its bottom; frames without an answer are unread.
    """
    f = frames.select("page_id", "frame_no", "nonce", B.box("x", "y", "width", "height").alias("fb"), "origin_x", "origin_y")
    under = (
        frames.alias("f").join(pages.alias("p"), F.expr("f.page_id = p.page_id AND p.y >= f.y + f.height"), "left")
        .groupBy("f.page_id", "f.frame_no").agg(F.min("p.pos").alias("at"))
    )
    i = inner.select("nonce", F.col("pos").alias("inner_pos"), "id", B.box("x", "y", "width", "height").alias("ib"), "is_visible")
    moved = f.join(i, "nonce").join(under, ["page_id", "frame_no"]).withColumn("b", B.move(F.col("ib"), F.col("origin_x"), F.col("origin_y")))
    seen = F.col("is_visible") & B.intersect(F.col("b"), F.col("fb")).isNotNull()
    order = lambda at, own, no, pos: F.struct(at.cast("long").alias("at"), own.alias("own"), no.cast("long").alias("no"), pos.cast("long").alias("pos"))
    embedded = moved.select("page_id", "id", "b.x", "b.y", "b.width", "b.height", seen.alias("is_visible"), F.lit(True).alias("embedded"), order(F.coalesce(F.col("at"), F.lit(2**31)), F.lit(0), F.col("frame_no"), F.col("inner_pos")).alias("_o"))
    own = pages.select("page_id", "id", "x", "y", "width", "height", "is_visible", F.lit(False).alias("embedded"), order(F.col("pos"), F.lit(1), F.lit(0), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("_o")) - 1
    merged = own.unionByName(embedded).withColumn("position", place).drop("_o")
    unread = frames.join(inner.select("nonce").distinct(), "nonce", "left_anti").select("page_id", "frame_no", "x", "y", "width", "height")
    return merged, unread


def nested_frames(frames: DataFrame, nested: DataFrame) -> DataFrame:
    """Frames inside frames, moved and clipped to their parent; those outside it are dropped. Keyed by nonce."""
    f = frames.select("page_id", "nonce", B.box("x", "y", "width", "height").alias("fb"), "origin_x", "origin_y")
    n = nested.select("nonce", B.box("x", "y", "width", "height").alias("nb"))
    cut = f.join(n, "nonce").withColumn("b", B.intersect(B.move(F.col("nb"), F.col("origin_x"), F.col("origin_y")), F.col("fb")))
    return cut.where("b IS NOT NULL").select("page_id", "b.x", "b.y", "b.width", "b.height")


def whole_frame_regions(frames: DataFrame, lines: DataFrame) -> DataFrame:
    """Frames without any line read become one region each (other, 1, ocr): what nobody could read is hidden."""
    return frames.join(lines.select("page_id", "frame_no").distinct(), ["page_id", "frame_no"], "left_anti").select(
        "page_id", "x", "y", "width", "height", F.lit("other").alias("category"), F.lit(1.0).alias("confidence"), F.lit("ocr").alias("method")
    )


def readable_lines(lines: DataFrame) -> DataFrame:
    """Recognised lines with text and a mean confidence of 0.5 or more, confidence with three decimals."""
    return lines.where((T.trim_all(F.col("text")) != "") & (F.col("confidence") >= 0.5)).withColumn("confidence", B.round3(F.col("confidence")))


def line_regions(lines: DataFrame) -> DataFrame:
    """Region rows of sensitive lines: their columns, category and method ocr."""
    # Every rule needs a digit or an at sign. A generator computes the category once; a filter on it would compute it again.
    worth = lines.where(F.col("text").rlike("[0-9@]"))
    return worth.withColumn("category", F.explode(F.array_compact(F.array(pii.sensitive_line(F.col("text")))))).withColumn("method", F.lit("ocr"))


def frames_in_view(frames: DataFrame) -> DataFrame:
    """Frames clipped to the viewport (vw, vh), at least 20 pixels a side."""
    cut = frames.withColumn("b", B.clip(B.box("x", "y", "width", "height"), F.col("vw"), F.col("vh"))).where("b.width >= 20 AND b.height >= 20")
    return cut.select("page_id", "frame_no", "b.x", "b.y", "b.width", "b.height")


def frame_number_of(element_id: Column) -> Column:
    """n of el_f<n>_<k>, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(element_id, r"^el_f(\d+)_", 1), F.lit("")).cast("int"), F.lit(0))


def control_labels(lines: DataFrame, by: str) -> DataFrame:
    """Text of a drawn control: its lines in reading order, joined by blanks, cut at 80."""
    e = F.struct(B.reading_row(B.box("x", "y", "width", "height"), 8).alias("row"), F.col("x").alias("lx"), F.col("text").alias("t"))
    return lines.groupBy(by).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(e)), lambda l: l["t"]), " "), 1, 80).alias("label"))


def device_ms(perception: Column) -> Column:
    return F.coalesce(perception["latencyMs"], F.lit(0.0)) + F.coalesce(perception["uiLatencyMs"], F.lit(0.0)) + F.coalesce(perception["ocrLatencyMs"], F.lit(0.0))


def ocr_totals(reads: DataFrame, by: str) -> DataFrame:
    """Lines and milliseconds of text recognition per step; unread frames count as nothing."""
    return reads.groupBy(by).agg(F.sum(F.coalesce("lines", F.lit(0))).alias("lines"), F.sum(F.coalesce("ms", F.lit(0))).alias("ms"))


def seen_by_vision(elements: DataFrame, visual: DataFrame) -> DataFrame:
    """Adds seen: does a box of the step name the element?"""
    hit = visual.where("matched_id IS NOT NULL").select("image_id", F.col("matched_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    return elements.join(hit, ["image_id", "id"], "left").withColumn("seen", F.col("_hit").isNotNull()).drop("_hit")


def set_attribute(elements: Column, ids: Column, key: str, value: str) -> Column:
    """Elements with one attribute set where the id is among ``ids``."""
    return F.transform(elements, lambda e: F.when(F.array_contains(ids, e["id"]), e.withField("attributes", V.override(e["attributes"], key, F.lit(value)))).otherwise(e))


def _number(v: Column) -> Column:
    return F.bround(v).cast("bigint").cast("string")


def element_line(e: Column, viewport: Column, image_attached: bool = False) -> Column:
    """One element as a prompt line: id | role | label | location [notes]."""
    b, a = e["bbox"], e["attributes"]
    at = lambda k: F.nullif(F.try_element_at(a, F.lit(k)), F.lit(""))
    place = F.concat(B.grid_word(b, viewport["width"], viewport["height"]), F.lit(" (x="), _number(b["x"]), F.lit(", y="), _number(b["y"]), F.lit(", w="), _number(b["width"]), F.lit(", h="), _number(b["height"]), F.lit(")"))
    line = F.concat_ws(" | ", e["id"], e["role"], F.concat(F.lit('"'), T.ellipsis(e["label"], 60), F.lit('"')), place)
    vision = F.coalesce(at("source") == "vision", F.lit(False))
    surface = F.coalesce(*(F.when(at("surface") == k, w) for k, w in _SURFACES.items()), F.lit(""))
    no_text = "no text: look at the screenshot at this spot" if image_attached else "no text available"
    notes = F.filter(
        F.array(
            *(F.concat(F.lit(f"{k}="), T.ellipsis(at(k), 40)) for k in ("type", "placeholder", "name", "title")),
            F.when(at("filled").isNotNull(), "ALREADY FILLED"), F.when(at("checked").isNotNull(), "checked"), F.when(at("frame") == "embedded", "inside an embedded frame"),
            F.when(vision, F.concat(F.lit("seen in the screenshot only"), surface)), F.when(vision & (at("labelFrom") == "ocr"), "text read from the pixels"), F.when(vision & (e["label"] == ""), no_text),
            F.when(~e["isInteractive"], "not interactive"), F.when(F.coalesce(e["redacted"], F.lit(False)), "label redacted"),
        ),
        lambda n: n.isNotNull(),
    )
    return F.when(F.size(notes) > 0, F.concat(line, F.lit(" ["), F.array_join(notes, ", "), F.lit("]"))).otherwise(line)


def _lines(*parts: Column) -> Column:
    return F.array_join(F.flatten(F.array(*parts)), "\n")


def _quoted(c: Column, limit: int) -> Column:
    return F.concat(F.lit('"'), T.ellipsis(c, limit), F.lit('"'))


def action_prompt(captures: DataFrame, max_elements: int, image_attached: bool = False) -> DataFrame:
    """Adds prompt: the step as text for a model to choose the next action from."""
    # The sentences below are the contract's.
    df = S.select_elements(captures.withColumn("_all", F.col("elements")), max_elements)
    els, all_, vp, none = F.col("elements"), F.col("_all"), F.col("viewport"), F.array().cast("array<string>")
    one = lambda c: F.array(c if isinstance(c, Column) else F.lit(c))
    label = lambda t: F.nullif(S.element_of(all_, t)["label"], F.lit(""))
    task = F.coalesce(F.nullif(T.trim_all(F.col("task")), F.lit("")), F.lit("(none given)"))
    past = F.transform(F.col("history"), lambda c, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), S.describe_past(c, label(c["target"]))))
    clicked = F.transform(S.clicked_labels(F.col("history"), all_), lambda n: _quoted(n, 50))
    again = F.concat(F.lit("Already clicked: "), F.array_join(clicked, ", "), F.lit(". Do not click these again unless the task asks for more than one or a page message says it is still needed."))
    messages = F.filter(F.transform(F.filter(all_, lambda e: e["role"] == "text"), lambda e: T.trim_all(e["label"])), lambda m: m != "")
    saved = F.coalesce(F.col("profileFields"), F.array().cast("array<struct<key:string,label:string>>"))
    used = F.transform(F.filter(F.col("history"), lambda c: (c["action"] == "type") & F.contains(c["text"], F.lit("{{"))), lambda c: c["text"])
    attr = lambda e, k: F.coalesce(F.try_element_at(e["attributes"], F.lit(k)), F.lit(""))
    empty = F.filter(all_, lambda e: (e["role"] == "textbox") & e["isInteractive"] & (attr(e, "filled") == "") & (attr(e, "type") != "password"))
    empties = F.transform(F.slice(empty, 1, 12), lambda e: F.concat(F.lit("  "), e["id"], F.lit(" "), _quoted(e["label"], 60), F.when(attr(e, "type") == "file", " (file upload: needs a saved file)").otherwise("")))
    n = F.size("redactions")
    text = _lines(
        one(F.concat(F.lit("Task: "), task)), one(""),
        one(F.concat(F.lit("Page: "), _quoted(F.col("page.title"), 80), F.lit(" ("), F.col("page.url"), F.lit(")"))),
        one(F.concat(F.lit("Viewport: "), _number(vp["width"]), F.lit("x"), _number(vp["height"]), F.lit(" CSS px. Locations are approximate: a 3x3 grid word, then x, y, width, height."))),
        one(F.concat(F.lit("Step: "), F.col("stepIndex").cast("string"))),
        F.when(F.size("history") > 0, F.concat(one("Previous actions (all already done successfully):"), past, F.when(F.size(clicked) > 0, one(again)).otherwise(none))).otherwise(one("Previous actions: none")),
        F.when(F.size(messages) > 0, F.concat(one("Page messages:"), F.transform(F.slice(messages, 1, 5), lambda m: F.concat(F.lit("  "), _quoted(m, 120))))).otherwise(none),
        F.when(
            F.size(saved) > 0,
            F.concat(
                one("Saved details (values hidden; type one by using its placeholder as the text):"),
                F.transform(saved, lambda f: F.concat(F.lit("  {{"), f["key"], F.lit("}} = "), T.ellipsis(f["label"], 40))),
                F.when(F.size(used) > 0, one(F.concat(F.lit("Already typed: "), F.array_join(used, ", "), F.lit(". Do not type these again.")))).otherwise(none),
                F.when(F.size(empty) > 0, F.concat(one("Empty fields still to fill, in order (fill the first one that has a matching saved detail):"), empties))
                .otherwise(one('Every field is filled. If the task asks to submit, click the submit button; otherwise reply "done".')),
            ),
        ).otherwise(none),
        F.when(n > 0, one(F.concat(F.lit("Redacted regions: "), n.cast("string"), F.lit(" area(s) hidden for privacy; their contents are unavailable.")))).otherwise(none),
        F.when(F.col("screenshot").isNull(), one("Screenshot: not provided; rely on the element list.")).otherwise(none),
        one(""), one("UI elements (id | role | label | location [notes]):"),
        F.when(F.size(els) > 0, F.transform(els, lambda e: element_line(e, vp, image_attached))).otherwise(one("(no visible elements)")),
        F.when(F.col("omitted") > 0, one(F.concat(F.lit("("), F.col("omitted").cast("string"), F.lit(" more elements omitted)")))).otherwise(none),
        one(""), one("Choose the single next action. Reply with ONLY the JSON object."),
    )
    return df.withColumn("prompt", text).withColumn("elements", all_).drop("_all", "omitted")


def question_prompt(captures: DataFrame) -> DataFrame:
    """Adds prompt: the page as text for a model to answer a question about."""
    # The sentences below are the contract's.
    one, none = (lambda c: F.array(c if isinstance(c, Column) else F.lit(c))), F.array().cast("array<string>")
    controls = F.slice(F.filter(F.col("elements"), lambda e: e["isInteractive"] & e["isVisible"]), 1, 40)
    kind = lambda e: F.when(e["role"] == "textbox", F.nullif(F.try_element_at(e["attributes"], F.lit("type")), F.lit("")))
    name = lambda e: F.coalesce(F.nullif(T.ellipsis(e["label"], 60), F.lit("")), F.lit("(no label)"))
    shown = F.transform(controls, lambda e: F.concat(F.lit("  - "), e["role"], F.coalesce(F.concat(F.lit(" ("), kind(e), F.lit(")")), F.lit("")), F.lit(": "), name(e)))
    body = T.ask_text(F.col("pageText"))
    text = _lines(
        one(F.concat(F.lit("Question: "), F.coalesce(F.nullif(T.trim_all(F.col("task")), F.lit("")), F.lit("Describe this page.")))), one(""),
        one(F.concat(F.lit("Page: "), _quoted(F.col("page.title"), 80), F.lit(" ("), F.col("page.url"), F.lit(")"))),
        one(F.concat(F.lit("Hidden on the user's device before sending: "), describe_regions(F.col("redactions")), F.lit("."))),
        F.when(F.size(controls) > 0, F.concat(one(""), one("Buttons, links and fields on screen:"), shown)).otherwise(none),
        one(""), F.when(body != "", F.array(F.lit('Visible page text:\n"""'), body, F.lit('"""'))).otherwise(one("Visible page text: not provided.")),
        one(""), one("Answer the question."),
    )
    return captures.withColumn("prompt", text)
