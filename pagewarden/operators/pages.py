"""HTML pages to tables: text nodes and candidate elements, with roles, labels, attributes and ids.

The parser is a small table-generating step (standard library, Arrow batches); every rule on top of it
is Catalyst. Boxes and styles exist only in a browser: rules that need them are in functions.boxes.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewarden.functions import pii, values
from pagewarden.functions import text as T

MAX_ELEMENTS, MAX_TEXT_NODES, MIN_TEXT = 200, 5000, 6
# Names of the contract.
ATTRIBUTES = ("type", "placeholder", "name", "title", "autocomplete", "aria-label", "href", "alt")
FORM_ROLES = ("textbox", "checkbox", "radio", "select", "button")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "noscript", "textarea"))
_ROLES = ("button", "link", "textbox", "checkbox", "radio")
NODES = "page_id long, kind string, pos int, tag string, attributes map<string,string>, text string, for_label string, labelled_by string, parent int"


class _Nodes(HTMLParser):
    """Open elements are a stack; an end tag closes up to its nearest open partner, or nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, number, hides text
        self.elements: list[dict] = []
        self.texts: list[tuple[str, int]] = []

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        parent = self.stack[-1][1] if self.stack else -1
        self.elements.append({"tag": tag, "attributes": own, "parent": parent, "text": []})
        if tag not in _VOID:
            hides = tag in _SILENT or own.get("contenteditable") == "true" or bool(self.stack and self.stack[-1][2])
            self.stack.append((tag, len(self.elements) - 1, hides))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        for tag, number, _ in self.stack:
            if _candidate(self.elements[number]) or tag in ("label", "title"):
                self.elements[number]["text"].append(data)
        if self.stack and not self.stack[-1][2]:
            self.texts.append((data, self.stack[-1][1]))


def _candidate(e: dict) -> bool:
    tag, a = e["tag"], e["attributes"]
    return (
        tag in ("button", "input", "select", "textarea", "h1", "h2", "h3") or (tag == "a" and "href" in a) or (tag == "img" and "alt" in a)
        or a.get("role") in (*_ROLES, "status", "alert") or a.get("contenteditable") == "true" or "aria-live" in a or "id" in a
    )


def nodes_of(html: str | None):
    """(kind, pos, tag, attributes, text, for_label, labelled_by, parent) of a page's candidate elements, then of its texts."""
    p = _Nodes()
    p.feed(html or "")
    p.close()
    labels = {e["attributes"]["for"]: "".join(e["text"]) for e in p.elements if e["tag"] == "label" and "for" in e["attributes"]}
    named: dict[str, str] = {}
    for e in p.elements:
        if "id" in e["attributes"]:
            named.setdefault(e["attributes"]["id"], "".join(e["text"]))
    for i, e in enumerate(p.elements):
        if _candidate(e):
            refs = [named[r] for r in e["attributes"].get("aria-labelledby", "").split() if r in named]
            yield "element", i, e["tag"], e["attributes"], "".join(e["text"]), labels.get(e["attributes"].get("id")), " ".join(refs) if refs else None, e["parent"]
    for i, (t, n) in enumerate(p.texts):
        yield "text", i, p.elements[n]["tag"], None, t, None, None, n


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_FIELDS = [(c.split()[0], _TYPES[c.split()[1]]) for c in NODES.split(", ")]
PARSED = 64  # pages whose nodes are held at once: a page has hundreds


def _parse(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, PARSED):
            part = batch.slice(at, PARSED)
            rows = [(page_id, *n) for page_id, html in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist()) for n in nodes_of(html)]
            columns = list(zip(*rows)) or [()] * len(_FIELDS)
            columns[4] = [None if a is None else list(a.items()) for a in columns[4]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])


def parse_pages(pages: DataFrame) -> DataFrame:
    """Nodes of pages (page_id, html): kind element or text, in document order; see NODES. Null html has none."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_parse, NODES)


class _PageNodes:
    def eval(self, html: str):
        yield from nodes_of(html)


def register_sql(spark: SparkSession) -> None:
    """The table function page_nodes(html): SELECT p.page_id, n.* FROM pages p, LATERAL page_nodes(p.html) n."""
    spark.udtf.register("page_nodes", F.udtf(_PageNodes, returnType=NODES.split(", ", 1)[1], useArrow=True))


def text_nodes(nodes: DataFrame) -> DataFrame:
    """Text nodes worth scanning: six characters trimmed or more, outside hidden tags, the first 5000 of a page."""
    kept = nodes.where("kind = 'text'").where(F.length(T.trim_all(F.col("text"))) >= MIN_TEXT)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return kept.withColumn("_n", rank).where(F.col("_n") <= MAX_TEXT_NODES).select("page_id", "pos", "tag", "text")


def page_pii(nodes: DataFrame) -> DataFrame:
    """(page_id, pos, start, end, kind, category) of personal data in scanned text nodes."""
    return text_nodes(nodes).select("page_id", "pos", F.explode(pii.pii_spans(F.col("text"))).alias("s")).select("page_id", "pos", "s.*")


def attribute(a: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(name)), F.lit(""))


def role_of(tag: Column, a: Column) -> Column:
    """Role from the aria role, tag and input type, in that order."""
    aria, kind = attribute(a, "role"), F.lower(attribute(a, "type"))
    live = aria.isin("status", "alert") | F.map_contains_key(a, "aria-live")
    return (
        F.when(aria.isin(*_ROLES, "option"), aria)
        .when(tag == "a", "link").when(tag == "button", "button").when(tag == "select", "select").when(tag == "option", "option")
        .when((tag == "textarea") | (attribute(a, "contenteditable") == "true"), "textbox")
        .when(tag == "img", "image").when(tag.rlike("^h[1-6]$"), "heading").when(live, "text")
        .when(tag == "input", F.when(kind == "checkbox", "checkbox").when(kind == "radio", "radio").when(kind.isin("button", "submit", "reset", "image"), "button").otherwise("textbox"))
        .otherwise("other")
    )


def label_of(tag: Column, a: Column, text: Column, for_label: Column, labelled_by: Column) -> Column:
    """Label by precedence: aria-label, aria-labelledby's texts, form label, button value, placeholder or name, alt, text cut at 200."""
    field, kind = tag.isin("input", "textarea", "select"), F.lower(attribute(a, "type"))
    own = lambda k: F.try_element_at(a, F.lit(k))
    some = lambda c: F.nullif(T.trim_all(c), F.lit(""))
    caption = F.when((tag == "input") & kind.isin("button", "submit", "reset"), F.nullif(own("value"), F.lit("")))
    in_form = F.coalesce(some(for_label), caption, own("placeholder"), own("name"), F.lit(""))
    other = F.when(tag == "img", F.coalesce(own("alt"), F.lit(""))).otherwise(T.cut(T.collapse(F.coalesce(text, F.lit(""))), 200))
    return F.coalesce(some(own("aria-label")), some(labelled_by), F.when(field, in_form), other)


def state_of(tag: Column, a: Column) -> Column:
    """filled or checked as yes; never a value."""
    kind = F.lower(attribute(a, "type"))
    yes = lambda k: F.create_map(F.lit(k), F.lit("yes"))
    none = F.create_map().cast("map<string,string>")
    typed = (tag == "input") & ~kind.isin("button", "submit", "reset", "image", "hidden", "checkbox", "radio", "file") & (attribute(a, "value") != "")
    return F.when((tag == "input") & kind.isin("checkbox", "radio") & F.map_contains_key(a, "checked"), yes("checked")).when(typed, yes("filled")).otherwise(none)


def control_class(tag: Column, a: Column) -> Column:
    """button, input or link for training labels; null for other tags and hidden inputs."""
    aria, kind = attribute(a, "role"), F.lower(attribute(a, "type"))
    return (
        F.when((tag == "input") & (kind == "hidden"), F.lit(None).cast("string"))
        .when((tag == "button") | (aria == "button") | ((tag == "input") & kind.isin("button", "submit", "reset", "image")), "button")
        .when(tag.isin("input", "textarea", "select") | aria.isin("textbox", "checkbox", "radio"), "input")
        .when(((tag == "a") & F.map_contains_key(a, "href")) | (aria == "link"), "link")
    )


def listed(tag: Column, a: Column) -> Column:
    """Is the node one that an element list takes up?"""
    aria = attribute(a, "role")
    return (
        tag.isin("button", "input", "select", "textarea", "h1", "h2", "h3") | ((tag == "a") & F.map_contains_key(a, "href")) | ((tag == "img") & F.map_contains_key(a, "alt"))
        | aria.isin(*_ROLES, "status", "alert") | (attribute(a, "contenteditable") == "true") | F.map_contains_key(a, "aria-live")
    )


def keep_element(role: Column, text: Column, visible: Column, rendered: Column) -> Column:
    """Visible elements, and form controls with a box even outside the viewport; empty status texts never."""
    empty = (role == "text") & (T.trim_all(F.coalesce(text, F.lit(""))) == "")
    return (visible | (role.isin(*FORM_ROLES) & rendered)) & ~empty


def element_table(nodes: DataFrame, prefix: str = "el_", limit: int | None = MAX_ELEMENTS) -> DataFrame:
    """(page_id, id, role, label, attributes, is_interactive, pos): the first elements of each page, or all without a limit, ids in first-seen order.

    Empty status texts are left out; attributes are those of the contract, cut at 100 characters, plus state.
    """
    e, a = nodes.where("kind = 'element'"), F.col("attributes")
    full = e.where(listed(F.col("tag"), a)).withColumn("role", role_of(F.col("tag"), a))
    full = full.where((F.col("role") != "text") | (T.trim_all(F.coalesce("text", F.lit(""))) != ""))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    kept = values.whitelist(a, ATTRIBUTES)
    both = F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), state_of(F.col("tag"), a))
    numbered = full.withColumn("_n", number)
    return (numbered if limit is None else numbered.where(F.col("_n") < limit)).select(
        "page_id", F.concat(F.lit(prefix), F.col("_n").cast("string")).alias("id"), "role", label_of(F.col("tag"), a, F.col("text"), F.col("for_label"), F.col("labelled_by")).alias("label"),
        F.when(F.size(both) > 0, both).alias("attributes"), (~F.col("role").isin("heading", "image", "text") & ~F.map_contains_key(a, "disabled")).alias("is_interactive"), "pos",
    )


def first_seen_ids(seen: DataFrame, scope: list[str], key: str, *order: str, prefix: str = "el_", start: int = 0) -> DataFrame:
    """(scope, key, id): stable ids in order of first sight, for elements, frames and vision cells."""
    first = seen.groupBy(*scope, key).agg(F.min(F.struct(*order)).alias("_at"))
    n = F.row_number().over(Window.partitionBy(*scope).orderBy("_at")) - 1 + start
    return first.select(*scope, key, F.concat(F.lit(prefix), n.cast("string")).alias("id"))


def vision_cell(x: Column, y: Column, node: Column) -> Column:
    """What a vision id stands for: a node and a 16-pixel cell."""
    return F.concat_ws(":", node.cast("string"), F.floor(x / 16 + 0.5).cast("string"), F.floor(y / 16 + 0.5).cast("string"))


def photo_regions(elements: DataFrame) -> DataFrame:
    """Regions (category photo, confidence 1, method dom) of picture-like elements of 20 pixels or more.

    ``elements`` has tag, attributes, background (css), box, wraps_img.
    """
    tag, a = F.col("tag"), F.col("attributes")
    picture = (tag.isin("img", "video", "canvas") | ((tag == "picture") & ~F.col("wraps_img")) | (attribute(a, "role") == "img")) & (tag != "svg")
    return elements.where((picture | F.coalesce(F.col("background").rlike(r"url\("), F.lit(False))) & (F.col("width") >= 20) & (F.col("height") >= 20)).select(
        "page_id", "x", "y", "width", "height", F.lit("photo").alias("category"), F.lit(1.0).alias("confidence"), F.lit("dom").alias("method")
    )


def adjudicate_points(points: DataFrame) -> DataFrame:
    """Adds reason (why a candidate point is dropped, else null) to points joined with the element they hit.

    ``points`` has image_id, idx, node (null: nothing hit), tag, disabled, listed_node, sensitive,
    is_surface, clickable. A node is claimed by its first point, surfaces (canvas, frame, image) by many.
    """
    first = F.row_number().over(Window.partitionBy("image_id", "node").orderBy("idx")) > 1
    return points.withColumn("_again", first).withColumn(
        "reason",
        F.when(F.col("node").isNull(), "nothing").when(F.col("disabled"), "disabled").when(F.col("listed_node"), "listed").when(F.col("sensitive"), "sensitive")
        .when(~F.col("clickable") & ~F.col("is_surface"), "not clickable").when(F.col("_again") & ~F.col("is_surface"), "claimed"),
    ).drop("_again")
