"""Raw model replies to typed commands, and rejects with a reason.

Parsing, unwrapping, key and action aliases, targets and coercions are Catalyst expressions over a map of
the reply's keys. Only replies that are no JSON as a whole or in a fence go through a Python function
that looks for the first object in free text or Python notation.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.functions import values as V
from pagewarden.operators import sessions as S
from pagewarden.operators.captures import valid_command

# The contract's aliases, wrappers and allowed fields.
ACTION_ALIASES = {
    "click": ("click", "press", "tap", "select", "choose", "check", "toggle", "submit", "click_element", "left_click", "push", "activate"),
    "type": ("type", "type_text", "input", "input_text", "fill", "fill_in", "enter_text", "write", "set_value", "send_keys"),
    "scroll": ("scroll", "scroll_down", "scroll_up", "scrolldown", "scrollup"),
    "navigate": ("navigate", "navigate_to", "go_to", "goto", "open", "open_url", "visit", "load"),
    "wait": ("wait", "sleep", "pause", "delay"),
    "done": ("done", "finish", "finished", "complete", "completed", "stop", "end", "task_complete", "task_done", "success"),
    "ask_user": ("ask_user", "ask", "question", "clarify", "ask_human", "request_input", "need_input"),
    "noop": ("noop", "no_op", "none", "nothing", "idle", "no_action", "skip", "null"),
}
KEY_ALIASES = {
    "action": ("action",),
    "target": ("target", "element", "element_id", "elementid", "target_id", "targetid", "target_element", "id", "selector", "element_index", "index"),
    "text": ("text", "value", "input", "input_text", "content", "query", "keys", "text_to_type"),
    "direction": ("direction", "dir"),
    "amountPx": ("amountpx", "amount_px", "amount", "pixels", "px", "distance"),
    "url": ("url", "href", "link", "address"),
    "ms": ("ms", "milliseconds", "millis", "duration", "duration_ms", "time_ms", "seconds"),
    "summary": ("summary", "result_summary"),
    "question": ("question",),
    "reason": ("reason",),
    "reasoning": ("reasoning", "explanation", "rationale", "thought", "thoughts", "why", "justification"),
    "confidence": ("confidence", "score", "probability"),
    "submit": ("submit", "press_enter", "enter_after", "hit_enter"),
}
WRAPPERS = ("command", "action_command", "actioncommand", "next_action", "response", "result", "output", "data")
ALLOWED = {
    "click": ("target",), "type": ("target", "text", "submit"), "scroll": ("direction", "amountPx"), "navigate": ("url",),
    "wait": ("ms",), "done": ("summary",), "ask_user": ("question",), "noop": ("reason",),
}
REQUIRED = {"click": ("target",), "type": ("target", "text"), "navigate": ("url",), "ask_user": ("question",), "wait": ("ms",), "scroll": ("direction",)}


def _objects(text: str):
    """Texts of the outermost {...} in a reply; braces within double quotes do not count."""
    depth = begin = 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}]', text, re.DOTALL):
        if m[0] == "{":
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[begin : m.end()]


def _read(text: str):
    plain = re.sub(r",\s*([}\]])", r"\1", text.strip())
    for attempt in (text.strip(), plain):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    words = {"true": "True", "false": "False", "null": "None"}
    try:
        return ast.literal_eval(re.sub(r"\b(true|false|null)\b", lambda m: words[m[0]], plain))
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


def first_object(raw: str | None) -> str | None:
    """The first object in free text as JSON, or nothing."""
    text = raw or ""
    fence = re.search(r"```(?:json|JSON)?\s*(.*?)```", text, re.DOTALL)
    for candidate in (text, *([fence[1]] if fence else ()), *_objects(text)):
        value = _read(candidate)
        if isinstance(value, list):
            value = next((v for v in value if isinstance(v, dict)), None)
        if isinstance(value, dict):
            return json.dumps({str(k): v for k, v in value.items()}, default=str)
    return None


@F.pandas_udf(T.StringType())
def _lenient(raw: pd.Series) -> pd.Series:
    return raw.map(first_object, na_action="ignore")


def _strict(text: Column) -> Column:
    """The text, or the first element of its array, if that is a JSON object."""
    fixed = F.regexp_replace(text, r",\s*([}\]])", "$1")
    whole = F.coalesce(F.when(F.try_parse_json(text).isNotNull(), text), F.when(F.try_parse_json(fixed).isNotNull(), fixed))
    head = F.get_json_object(whole, "$[0]")
    return F.when(F.startswith(F.trim(whole), F.lit("{")), whole).when(F.startswith(F.trim(whole), F.lit("[")) & F.startswith(head, F.lit("{")), head)


def extract_object(df: DataFrame, raw: str, out: str = "object") -> DataFrame:
    """Adds the reply's first JSON object as text, null without one."""
    text = F.regexp_replace(F.col(raw), r"(?s)^\s+|\s+$", "")
    fence = F.regexp_extract(text, r"(?s)```(?:json|JSON)?\s*(.*?)\s*```", 1)
    native = df.withColumn(out, F.coalesce(_strict(text), F.when(fence != "", _strict(fence))))
    # One branch: the reader sees only what is left, and nothing in place of the rest.
    hard = F.when(F.col(out).isNull() & F.contains(F.col(raw), F.lit("{")), F.col(raw))
    return native.withColumn(out, F.coalesce(out, _lenient(hard)))


def _key(k: Column) -> Column:
    return F.translate(F.lower(F.trim(k)), "- ", "__")


def _entries(obj: Column) -> Column:
    """(key, value) pairs of an object in order, keys normalised; values as text."""
    pairs = F.map_entries(F.from_json(obj, "map<string,string>"))
    return F.transform(pairs, lambda e: F.struct(_key(e["key"]).alias("key"), e["value"].alias("value")))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(v, F.lit("{")), F.lit(False))


def _wrapped(wrapper: str) -> Column:
    return F.get(F.filter("_e", lambda e: (e["key"] == wrapper) & _is_object(e["value"])), F.lit(0))["value"]


def unwrap(df: DataFrame, obj: str = "object") -> DataFrame:
    """{"command": {...}} to {...}, up to three times, while the wrapper has no action of its own."""
    for _ in range(3):
        df = df.withColumn("_e", _entries(F.col(obj)))
        own = F.exists("_e", lambda e: e["key"].isin("action", "type"))
        inner = F.coalesce(*map(_wrapped, WRAPPERS))
        df = df.withColumn(obj, F.when(own | inner.isNull(), F.col(obj)).otherwise(inner)).drop("_e")
    return df


def _lookup(words: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(F.lit(x) for k, aliases in words.items() for a in aliases for x in (a, k)))


def canonical_fields(df: DataFrame, obj: str = "object") -> DataFrame:
    """Adds fields: (key, raw, value) with canonical keys, the first alias of each in order."""
    e = _entries(F.col(obj))
    has_action = F.exists(e, lambda x: x["key"] == "action")
    name = lambda x: F.when((x["key"] == "type") & ~has_action & ~_is_object(x["value"]), "action").otherwise(F.try_element_at(_lookup(KEY_ALIASES), x["key"]))
    named = F.transform(e, lambda x: F.struct(name(x).alias("key"), x["key"].alias("raw"), x["value"].alias("value")))
    return df.withColumn("fields", F.filter(named, lambda x: x["key"].isNotNull()))


def _field(k: str) -> Column:
    return F.get(F.filter("fields", lambda f: f["key"] == k), F.lit(0))["value"]


def _has(k: str) -> Column:
    return F.exists("fields", lambda f: f["key"] == k)


def action_of(df: DataFrame) -> DataFrame:
    """Adds action, and rest_target and implied_direction from values such as "click el_1" or scroll_down."""
    said = F.lower(F.trim(_field("action")))
    tokens = F.filter(F.split(said, r"\s+"), lambda t: t != "")
    head = F.regexp_replace(F.translate(F.get(tokens, F.lit(0)), "-", "_"), "^[.:,]+|[.:,]+$", "")
    joined = F.translate(F.array_join(tokens, "_"), "-", "_")
    rest = F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), " ")
    df = df.withColumn("_joined", joined).withColumn("_head", head).withColumn("_rest", rest).withColumn("_words", _lookup(ACTION_ALIASES))
    by_joined, by_head = F.try_element_at("_words", F.col("_joined")), F.try_element_at("_words", F.col("_head"))
    used = F.when(by_joined.isNotNull(), F.col("_joined")).when(by_head.isNotNull(), F.col("_head"))
    inferred = (
        F.when(_has("text") & _has("target"), "type").when(_has("target"), "click").when(_has("url"), "navigate")
        .when(_has("question"), "ask_user").when(_has("summary"), "done").when(_has("direction"), "scroll")
    )
    silent = F.coalesce(_field("action"), F.lit("")) == ""
    alias = F.coalesce(by_joined, by_head)
    more = (used == F.col("_head")) & (F.col("_rest") != "")
    return (
        df.withColumn("action", F.coalesce(alias, F.when(silent, inferred)))
        .withColumn("implied_direction", F.when(used.isin("scroll_down", "scrolldown"), "down").when(used.isin("scroll_up", "scrollup"), "up").when(more & (alias == "scroll") & F.col("_rest").isin("up", "down"), F.col("_rest")))
        .withColumn("rest_target", F.when(more & alias.isin("click", "type"), F.col("_rest")))
        .drop("_joined", "_head", "_rest", "_words")
    )


def resolve_target(value: Column, elements: Column) -> Column:
    """An element id from an id, "vis 3", "#4", "element 4", a number, or a label that fits one element only."""
    inner = F.coalesce(*(F.nullif(F.get_json_object(value, f"$.{k}"), F.lit("")) for k in ("id", "target", "label")))
    s = F.regexp_replace(F.trim(F.when(_is_object(value), inner).otherwise(value)), "^[\"']+|[\"']+$", "")
    number = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit("")).try_cast("decimal(20,0)").cast("string")
    low = F.lower(s)
    exact = F.filter(elements, lambda e: F.lower(F.trim(e["label"])) == low)
    partial = F.filter(elements, lambda e: (low != "") & F.contains(F.lower(e["label"]), low))
    only = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))["id"])
    return F.coalesce(
        F.when(F.array_contains(F.transform(elements, lambda e: e["id"]), s), s),
        F.concat(F.lit("vis_"), number(r"(?i)^\s*vis(?:ion)?[\s_\-:#]*(\d+)\s*$")),
        F.concat(F.lit("el_"), number(r"(?i)^\s*#?\s*(?:el|elem|element|id)?[\s_\-:#]*(\d+)(?:\.\d+)?\s*$")),
        only(exact), only(partial), s,
    )


def normalise(replies: DataFrame, raw: str = "raw", elements: str = "elements") -> DataFrame:
    """Adds command (null if unusable) and reject (why, null if usable) to replies and the elements they were about."""
    df = action_of(canonical_fields(unwrap(extract_object(replies, raw))))
    some = lambda c: F.nullif(c, F.lit(""))
    act, els = F.col("action"), F.col(elements)
    target = F.when(_has("target"), _field("target")).otherwise(F.col("rest_target"))
    said = F.lower(F.trim(F.when(_has("direction"), _field("direction")).otherwise(F.col("implied_direction"))))
    seconds = F.coalesce(F.get(F.filter("fields", lambda f: f["key"] == "ms"), F.lit(0))["raw"] == "seconds", F.lit(False))
    reasoning = F.coalesce(_field("reasoning"), F.when(act != "noop", _field("reason")))
    value = {
        "target": resolve_target(target, els),
        "text": F.when(_has("text"), F.coalesce(_field("text"), F.lit(""))),
        "submit": V.boolean(_field("submit")),
        "direction": F.when(said == "top", "up").when(said.isNull() | said.isin("", "bottom"), "down").otherwise(said),
        "amountPx": _field("amountPx").try_cast("double"),
        "url": _field("url"),
        "ms": F.when(_has("ms"), V.milliseconds(_field("ms"), seconds)).otherwise(F.lit(1000).cast("bigint")),
        "summary": F.coalesce(some(_field("summary")), some(reasoning), some(_field("text")), F.lit("Task reported complete.")),
        "question": F.coalesce(some(_field("question")), some(_field("text")), some(reasoning)),
        "reason": F.coalesce(some(_field("reason")), some(_field("reasoning")), some(_field("summary")), some(_field("text")), F.lit("no reason given")),
    }
    allowed = {k: [a for a, fields in ALLOWED.items() if k in fields] for k in value}
    parts = [F.when(act.isin(*allowed[k]), v).alias(k) for k, v in value.items()]
    command = F.struct(act.alias("action"), *parts, reasoning.alias("reasoning"), V.confidence(_field("confidence")).alias("confidence")).cast(S.COMMAND)
    df = df.withColumn("_c", command)
    c = F.col("_c")
    lacks = F.coalesce(*(F.when((act == a) & c[f].isNull(), F.concat(F.lit(f"{a}.{f}: Field required"))) for a, fields in REQUIRED.items() for f in fields))
    unknown = F.concat(F.lit("unknown target '"), c["target"], F.lit("'; valid ids are "), S.describe_ids(els))
    reject = (
        F.when(F.coalesce(F.col(raw), F.lit("")).rlike(r"^\s*$"), "model returned empty output")
        .when(F.col("object").isNull(), "no JSON object found in model output")
        .when(act.isNull(), F.concat(F.lit("unknown action '"), F.coalesce(_field("action"), F.lit("")), F.lit("'")))
        .when(lacks.isNotNull(), lacks)
        .when(~valid_command(c), F.concat(act, F.lit("."), F.when(act == "wait", "ms").when(act == "scroll", "direction").otherwise("target"), F.lit(": out of range")))
        .when(~S.known_target(els, c["target"]), unknown)
    )
    return df.withColumn("reject", reject).withColumn("command", F.when(F.col("reject").isNull(), c)).drop("_c", "object", "fields", "action", "implied_direction", "rest_target")


def resolve_attempts(normalised: DataFrame, by: str, attempt: str = "attempt", raw: str = "raw") -> DataFrame:
    """Per step the first usable of at most two attempts, else failed with both raw texts cut at 400."""
    two = normalised.where(F.col(attempt) <= 2)
    cut = F.array_sort(F.collect_list(F.struct(attempt, F.substring(raw, 1, 400).alias("t"))))
    first = F.min_by("command", F.when(F.col("command").isNotNull(), F.col(attempt)))
    return two.groupBy(by).agg(first.alias("command"), F.transform(cut, lambda x: x["t"]).alias("_raws")).select(
        by, "command", F.col("command").isNull().alias("failed"), F.when(F.col("command").isNull(), F.col("_raws")).alias("raws")
    )
